"""Log tails, run scans, skill and workflow files, table functions."""

import json
import random

import pytest

from brindle.functions import tables
from brindle.operators import lint, search
from brindle.plans.intake import STEP_CONTRACT
from brindle.sources import files, tails


def test_tails(spark, tmp_path):
    rng = random.Random(3)
    logs = {f"sub {i}/job%41 {i}.log": "".join(rng.choices("aé漢😀\n", k=n)).encode() for i, n in enumerate([2, 1, 49, 50, 51, 5000])}
    logs["junk.log"] = bytes(rng.randrange(256) for _ in range(3000))
    logs["continuations.log"] = b"\x80" * 1000
    for name, data in logs.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path.split("/")[-1]: r for r in tails.read_tails(spark, str(tmp_path), 50).collect()}
    assert len(got) == len(logs)
    for name, data in logs.items():
        r = got[name.split("/")[-1]]
        assert r.tail == data.decode("utf-8", "replace")[-50:] and r.error is None
        assert r.length == len(data) and r.bytes_read == min(len(data), 204)


def test_a_log_that_can_not_be_read(spark, tmp_path):
    (tmp_path / "a.log").write_text("x")

    def gone(path):
        raise FileNotFoundError(path)

    r = tails.read_tails(spark, str(tmp_path), opener=gone).first()
    assert r.tail == "" and r.error.startswith("FileNotFoundError")


def test_job_logs(spark, tmp_path):
    for name, text in {"a": "limit reached" + "x" * 2500, "b": "x" * 4000 + " Usage LIMIT reached ", "c": "API key bad"}.items():
        (tmp_path / f"{name}.log").write_text(text)
    found = tails.job_logs(tails.read_tails(spark, str(tmp_path)), {"limit reached": "limit", "api key": "login"})
    assert {r.path[-5]: r.cause for r in found.collect()} == {"a": None, "b": "limit", "c": "login"}
    assert all(len(r.tail) <= 3000 for r in found.collect())


def test_runs(spark, tmp_path):
    runs = {
        "r1": {"id": "A", "fd_source": "f.md", "workflow": "", "steps": [{"n": 1}, {"n": 13}, {"n": "14"}]},
        "r2": {"id": "A-R2", "fd_source": "f.md", "selected_is_btp": True, "steps": [{"n": 13, "name": "renamed", "status": "N/A"}, {"n": 14, "status": "pass", "detail": "own"}]},
        "r10": {"id": "A-R10", "fd_source": "f.md", "mode": "Side by side", "steps": None},
        "other": {"title": "no id", "checkpoint_request": {"approach_options": [{"id": "x", "recommended": True, "naming_contract": [{"name": "ZX"}]}, {"id": "y", "mandated": True, "feasible": False, "naming_contract": [{"name": "ZY"}]}]}},
    }
    for folder, body in runs.items():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "run.json").write_text(json.dumps(body) + ("} trailing" if folder == "r1" else ""))
        (tmp_path / folder / "note.md").write_text("n")
        (tmp_path / folder / ".hidden").write_text("h")
    (tmp_path / "r1" / "deep").mkdir()
    (tmp_path / "r1" / "deep" / "run.json").write_text('{"id": "deeper"}')
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "run.json").write_text("no json")
    got = {r.folder: r for r in files.read_runs(spark, str(tmp_path), STEP_CONTRACT).collect()}
    assert set(got) == set(runs)
    assert [s.n for s in got["r1"].steps] == ["1"] and not got["r1"].side and got["r1"].workflow == "RICEFW Pipeline (12 steps)"
    a, b = got["r2"].steps
    assert (a.name, a.status, a.detail) == ("step 13", "PENDING", "waits") and (b.status, b.detail, b.gate) == ("pass", "own", "G14")
    assert got["r10"].side and got["r10"].steps is None
    assert [(got[k].version, got[k].previous_run, got[k].run_count) for k in ("r1", "r2", "r10")] == [(1, None, 3), (2, "A", 3), (10, "A-R2", 3)]
    assert [n.name for n in got["other"].names] == ["ZX"] and got["r1"].names is None and got["other"].version == 1
    assert got["r1"].files == ["note.md"]
    assert files.read_run_file(spark, str(tmp_path), "r1", "note.md").first().value == "n"
    for bad in (("..", "x"), ("r1", "../x"), ("r1", ""), ("a/b", "c"), (".", "run.json")):
        with pytest.raises(ValueError):
            files.read_run_file(spark, str(tmp_path), *bad)


def test_skills_and_workflows(spark, tmp_path):
    (tmp_path / "skills" / "one").mkdir(parents=True)
    (tmp_path / "skills" / "one" / "SKILL.md").write_text("---\nname: one\ndescription: does  things \n---\n" + "x" * 2000)
    (tmp_path / "skills" / "one" / "other.md").write_text("description: no")
    (tmp_path / "wf").mkdir()
    for name, text in {"ricefw-a.md": "# The Title \n**Skill:** `s` and **t**\n**Realization:** *r*", "b.md": "text\n# late heading\n**Skill:** only `s`", "c.md": "\n", "d.txt": "# no"}.items():
        (tmp_path / "wf" / name).write_text(text)
    (s,) = files.skill_rows(files.read_texts(spark, f"{tmp_path}/skills/*/SKILL.md")).collect()
    assert (s.name, s.description, s.size_kb) == ("one", "does  things", 2.0) and s.content.startswith("---")
    w = {r.file: (r.title, r.type, r.description) for r in files.workflow_rows(files.read_texts(spark, f"{tmp_path}/wf/*.md")).collect()}
    assert w == {"ricefw-a.md": ("The Title", "RICEFW", "r"), "b.md": ("b", "Process", "only s"), "c.md": ("c", "Process", "")}


RULES = [("A", "error", r"pass\b", "m"), ("B", "warning", r"(open", None), ("C", "warning", "x+$", None)]


def test_table_functions(spark):
    docs = spark.createDataFrame([(1, "pass\n xx ", 0), (2, None, 0), (3, "", 0), (None, "a\r\npass xx\rxx\n", 0), (4, "é pass" + "y" * 300 + "xx", 0), (5, "alpha beta alpha the İx Kx", 0)], "id long, body string, line int")
    rules = tables.rules_of(spark.createDataFrame(RULES, "id string, severity string, pattern string, message string"))
    assert [r.id for r in rules] == ["A", "C"] and rules[1].message == ""
    tables.register(spark, rules)
    key = lambda r: (r.id or 0, r.line, r.rule)
    got = spark.sql("SELECT * FROM lint(TABLE(SELECT * FROM {d}))", d=docs)
    assert sorted(map(tuple, got.collect()), key=lambda t: (t[0] or 0, t[4], t[1])) == [tuple(r) for r in sorted(lint.lint(docs, rules, "id", "body").collect(), key=key)]
    assert dict(got.dtypes)["id"] == "bigint" and got.count() == 6
    terms = spark.sql("SELECT * FROM terms(TABLE(SELECT id, body FROM {d}))", d=docs)
    want = search.term_counts(docs, "id", "body").select("doc_id", "term", "tf", "n_terms")
    assert sorted(map(str, terms.collect())) == sorted(str(r).replace("doc_id", "id") for r in want.collect())
    with pytest.raises(ValueError, match="more than 2"):
        tables.rules_of(spark.createDataFrame(RULES, "id string, severity string, pattern string, message string"), 2)
    with pytest.raises(Exception, match="id, text"):
        spark.sql("SELECT * FROM terms(TABLE(SELECT id FROM {d}))", d=docs).collect()
