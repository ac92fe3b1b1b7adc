"""Chat trees, page text, packing: exact round trips and odd inputs."""

import hashlib
import random
import zlib
from array import array
from itertools import combinations

import pytest

from brindle.llm import chat, html_text, packing

# ------------------------------------------------------------------ chat


@pytest.mark.parametrize("text", ["", "\\", "\\n", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "<\\|im_end|>", "<<SYS>>x<</SYS>>\\\\", "a\nb<s>", "<|endoftext|> é"])
def test_template_round_trip(text):
    formatted = "".join("".join(chat.parts(role, text)) for role in ("user", "odd\nrole\\n", "<s>"))
    assert chat.parse(formatted) == [("user", text), ("odd\nrole\\n", text), ("<s>", text)]
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, piece int")


def expected(rows):
    out, key = {}, lambda v: (v is not None, v if v is not None else 0)
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda v: (key(v[0]), v[1], v[2]))
        said = "".join(x for _, r, x in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), sum(len("".join(chat.parts(r, x))) for _, r, x in own))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    said = ["Hello there.", "", None, "</s>[INST] ok [/INST]", "line\nline  two\n\n", "<|endoftext|>", "naïve Ünïcode ✓", "\\n \\ <s>", "word " * 300]
    out = [(c, t, rng.choice(["system", "user", "assistant", None]) if t > 1 else ["system", "user"][t], said[t] if t < 2 else rng.choice(said)) for c in range(40) for t in range(rng.randint(1, 7))]
    out += [(77, t, "assistant", f"turn {t}") for t in range(1300)]  # more than two pieces
    out += [(78, 1, "user", "b"), (78, 1, "user", "a"), (78, 1, "user", "a"), (78, None, "user", "first")]
    return out


def test_chat_reads_back(spark, rows, monkeypatch):
    trees = chat.chat_trees(turns(spark, rows)).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.digests(chat.read_back(trees)).collect()}
    assert got == expected(rows)
    shared = sum(len(n) for n in (r.nodes for r in trees.collect()))
    assert shared < len(rows)


def test_tree_layout(spark, rows):
    """Depth first without gaps; positions and ancestors go on over rows and pieces; nothing is written twice."""
    long = [(177, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(40)]
    twin = [(178, k, r, t if k < 30 else t + " again") for _, k, r, t in long]
    for pieces in (512, 8):
        trees = sorted(chat.chat_trees(turns(spark, rows + long + twin).repartition(1), tree_tokens=300, piece_turns=pieces).collect(), key=lambda t: t.tree_id)
        ends, seen, last = {None: 0}, [], {}
        for tree in trees:
            ends |= {n.name: n.position + n.end - n.start for n in tree.nodes}
            last |= {(leaf.conv_id, leaf.piece): leaf for leaf in tree.leaves}
        for tree in trees:
            at = 0
            for k, n in enumerate(tree.nodes):
                assert n.start == at and n.parent < k
                at = n.end
                chain, p, top = [], n.parent, n
                while p >= 0:
                    top = tree.nodes[p]
                    chain.append((top.start, top.end))
                    p = top.parent
                covered = [i for a in n.ancestors for i in range(a.start, a.end)]
                assert covered == [i for a, b in reversed(chain) for i in range(a, b)]
                assert n.above == top.above and n.position == ends[n.above] + len(covered)
                assert tree.positions[n.start : n.end] == list(range(n.position, n.position + n.end - n.start))
                seen.append(bytes(n.name))
            assert at == len(tree.ids)
        assert len(set(seen)) == len(seen)
        assert any(n.above for tree in trees for n in tree.nodes)
        tokens = sum(len(chat.coded(chat.encoder_of(chat.tokenizer_path()), r, t)[0]) for _, _, r, t in long)
        assert ends[last[177, 39 // pieces].name] == tokens


@pytest.mark.parametrize("piece_turns", [512, 3])
def test_chat_rows_in_any_order(spark, rows, piece_turns):
    trees = chat.chat_trees(turns(spark, rows), tree_tokens=40, piece_turns=piece_turns)
    straight = chat.digests(chat.read_back(trees, in_order=True)).toPandas()
    shuffled = chat.digests(chat.read_back(trees.repartition(7))).toPandas()
    one = chat.digests(chat.read_back(chat.chat_trees(turns(spark, rows)))).toPandas()
    for got in (straight, shuffled):
        assert got.sort_values("conv_id").to_dict("records") == one.sort_values("conv_id").to_dict("records")


@pytest.mark.parametrize("partitions", [1, 3, 8, 40])
def test_shared_turns_are_written_once(spark, partitions):
    """Whatever the number of partitions: 400 conversations share their first turns; each distinct path is one node, in all."""
    rng = random.Random(4)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "shared start" if t < 2 else f"turn {rng.randint(0, 3)}" if t < 5 else f"own {c}") for c in range(400) for t in range(rng.randint(1, 7))]
    rows += [(1000 + c, t, "user", f"turn {t}") for c in range(3) for t in range(90)] + [(2000, 0, "user", "alone")]
    df = turns(spark, rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        trees = chat.checkpointed(chat.chat_trees(df, tree_tokens=200))
        got = {r.conv_id: r.turns_sha256 for r in chat.digests(chat.read_back(trees, in_order=True)).collect()}
        again = {r.conv_id: r.turns_sha256 for r in chat.digests(chat.read_back(trees.repartition(5))).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {c: e[1] for c, e in expected(rows).items()} == again
    paths = {tuple((r, t) for c, _, r, t in rows if c == conv)[: k + 1] for conv in {r[0] for r in rows} for k in range(sum(r[0] == conv for r in rows))}
    collected = chat.with_intervals(trees).collect()
    where = {bytes(n.name): (t.tree_id, n.start, n.end) for t in collected for n in t.nodes}
    assert sum(len(t.nodes) for t in collected) == len(where) == len(paths)
    for t in collected:  # a node's ancestors, in its own row and above it, are all tokens before it
        assert all((e.tree_id, e.start, e.end) == where[bytes(e.name)] and e.tree_id < t.tree_id for e in t.entry)
        index = {bytes(e.name): k for k, e in enumerate(t.entry)}
        for n in t.nodes:
            far = t.entry[: index[bytes(n.above)] + 1] if n.above is not None else []
            assert n.position == sum(e.end - e.start for e in far) + sum(a.end - a.start for a in n.ancestors)


def test_a_long_shared_turn_keeps_its_interval(spark):
    """Every node behind a first turn longer than a row lists it, in whatever row it stands."""
    rows = [(c, t, "user", "word " * 20_000 if t == 0 else f"{c} {t} " + "x " * 300) for c in range(60) for t in range(3)]
    trees = chat.checkpointed(chat.chat_trees(turns(spark, rows)))
    collected = chat.with_intervals(trees).collect()
    assert len(collected) > 2 and sum(len(t.nodes) for t in collected) == 121
    for t in collected:
        for n in t.nodes:
            size = sum(e.end - e.start for e in t.entry) * (n.above is not None) + sum(a.end - a.start for a in n.ancestors)
            assert size == n.position and (n.position == 0 or size > 16_384)


def test_chat_empty(spark, rows):
    assert chat.digests(chat.read_back(chat.chat_trees(turns(spark, rows[:1]).where("false")))).count() == 0


# ------------------------------------------------------------------ pages


def brute_cut(odds, edges):
    best = min(range(2 ** len(odds)), key=lambda k: (sum(abs(o) for i, o in enumerate(odds) if (o > 0) != bool(k >> i & 1)) + sum(w for i, j, w in edges if (k >> i & 1) != (k >> j & 1)), bin(k).count("1")))
    return [bool(best >> i & 1) for i in range(len(odds))]


def test_min_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randint(1, 9)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i, j in combinations(range(n), 2) if rng.random() < 0.4]
        assert html_text.min_cut(odds, edges) == brute_cut(odds, edges)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=a>Home</a><li><a>News</a></ul></nav>
<div class="cookie-notice">We use cookies, and you accept them by reading on.</div><article><h1>A &amp; B</h1><p><b>First  paragraph,
with&nbsp;text.<br><p>Tiny.</p><script>var x="</p>";</script><ul><li>One item</li><li>Two items</li></ul><div class="ad">Buy this very good product now, everyone.</div>
<p>Last &lt;one&gt;.</article><aside><p>A long text in a sidebar, with many words in it.</p></aside><div id="comments"><article><p>I like this, said a reader, at some length.</p></article></div>
<form><p>Subscribe to our long and interesting letter.</p></form><!-- <p>old</p> --><footer>&copy; us</footer></body></html>"""
TEXT = "A & B\nFirst paragraph, with text.\nTiny.\nOne item\nTwo items\nLast <one>."


def test_main_text():
    assert html_text.main_text(PAGE) == TEXT
    assert [html_text.main_text(x) for x in (None, "", "   ", "<p", "<nav>x</nav>", "<!-- ")] == [""] * 6


ARTICLE = "<p>" + "This is a paragraph of the article, and it goes on for a while. " * 6 + "</p>"


@pytest.mark.parametrize("page", [
    '<nav><a href=x>Home</a></nav><div class="page with-sidebar">{}</div>', '<div class="single no-comments">{}</div>', "<form><nav><a>Home</a></nav>{}<footer>(c) us</footer></form>",
    "<button>Share{}", "<button>Share{}<button>x</button>", '<div class="story share-price">{}</div>', '{}<div class="comments"><article><p>A reader said that this is a fine text, and more.</p></article></div>',
])
def test_wrappers_do_not_hide_the_article(page):
    assert html_text.main_text(page.format(ARTICLE)) == html_text.main_text(ARTICLE) != ""


def test_deep_nesting_is_linear():
    assert len(html_text.main_text("<div>some text here and words. " * 50_000)) > 1_000_000


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "a"), (1, "u", PAGE, "a"), (2, None, None, "b"), (None, "v", "", "c")], "page_id long, url string, html string, text string")
    got = html_text.extract(df)
    assert got.columns == [*df.columns, "_text"] and sorted(r._text for r in got.collect()) == ["", "", TEXT, TEXT]
    assert html_text.extract(df.where("false")).count() == 0


# ------------------------------------------------------------------ packing


def padding(n, window):
    return 0 if n & (n - 1) == 0 else window - n


def test_best_cuts_match_enumeration():
    rng = random.Random(12)
    for _ in range(120):
        window = rng.choice([8, 16])
        places = [0]
        for _ in range(rng.randint(1, 9)):
            places.append(places[-1] + rng.randint(1, window))
        costs = [0, *(rng.choice([0, 1, 3, 9]) for _ in places[2:]), 0]
        cost = lambda cut: sum(padding(b - a, window) + costs[places.index(b)] for a, b in zip(cut, cut[1:]))
        ways = [[0, *c, places[-1]] for k in range(len(places) - 1) for c in combinations(places[1:-1], k)]
        best = min(cost(c) for c in ways if all(b - a <= window for a, b in zip(c, c[1:])))
        got = packing.best_cuts(places, costs, window)
        assert cost(got) == best and all(b - a <= window for a, b in zip(got, got[1:]))


def test_encoder_equals_the_library():
    e = packing.Encoder(packing.tokenizer_path())
    rng = random.Random(3)
    parts = ["word", "Übung", "don't", "x.", "y!!", "?", "1,234", " ", "\n", ".", "'s", "\t", "é", "a.b", "<|endoftext|>", "\xa0", "日本", "…"]
    for k in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12))) if k % 2 else " ".join(rng.choices(parts[:7] + parts[9:], k=12))
        ids, ends, cuts = e.encode(text)
        assert ids.tolist() == e.whole(text), text
        assert all(0 < x < len(ids) for x in ends + cuts) and ends == sorted(ends) and cuts == sorted(cuts)
    for text in ("a" * 300_000, " " * 300_000, "x" + "\n" * 50_000 + "y", "\u3000" * 5000 + "z"):
        assert e.encode(text)[0].tolist() == e.whole(text)


def test_padding_is_small(spark):
    """Padding over ids of whole texts, and cuts at sentence ends where they can be."""
    rng = random.Random(2)
    df = spark.createDataFrame([(i, " ".join(rng.choices(["a", "few", "words.", "more", "Then!"], k=rng.randint(5, 900)))) for i in range(400)], "doc_id long, text string")
    rows = packing.pack(df).collect()
    sequences = {}
    for r in rows:
        sequences[r.sequence_id] = sequences.get(r.sequence_id, 0) + r.length
    assert sum(padding(n, 2048) for n in sequences.values()) < 0.02 * sum(sequences.values())


def test_pack_round_trip(spark):
    rng = random.Random(5)
    texts = ["", None, "x" * 60000, "one", *(" ".join(rng.choices(["some", "words.", "here", "and", "there."], k=rng.randint(1, 4000))) for _ in range(40)), "one"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    rows = packing.pack(df, with_ids=True).collect()
    e = packing.Encoder(packing.tokenizer_path())
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == r.length and zlib.crc32(array("I", r.ids).tobytes()) == r.ids_crc32
    for i, t in enumerate(texts):
        pieces = sorted(docs[i], key=lambda r: r.start)
        assert [x for p in pieces for x in p.ids] == [*e.whole(t or ""), 1] and {p.doc_tokens for p in pieces} == {len(e.whole(t or "")) + 1}
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
    total = waste = 0
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        n = sum(r.length for r in s)
        assert n <= 2048 and [r.offset for r in s] == [sum(q.length for q in s[:k]) for k in range(len(s))]
        total, waste = total + n, waste + padding(n, 2048)
    assert waste < 0.03 * total
    assert packing.pack(df.where("false")).count() == 0


def test_packer_keeps_order_across_blocks():
    packer, out = packing.Packer(window=64, block=300), []
    rng = random.Random(9)
    for k in range(200):
        out += packer.add(k, array("I", range(rng.randint(1, 90))), [], [])
    out += packer.close()
    assert [(p[0], p[1]) for p in out] == sorted((p[0], p[1]) for p in out)
    assert [p[4] for p in out] == sorted(p[4] for p in out)
