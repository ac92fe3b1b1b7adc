"""Run manifests with what is derived from them: variant, label, visible steps, version chain, names and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import runs

NAME = "struct<name: string, type: string, created_in: string, description: string>"
OPTION = f"struct<id: string, mandated: boolean, feasible: boolean, recommended: boolean, naming_contract: array<{NAME}>>"
STEP = "struct<n: string, name: string, agent: string, gate: string, status: string, detail: string>"
#: What is read of a manifest; other fields are left alone.
MANIFEST = (
    f"id string, title string, fd_source string, workflow string, mode string, status string, created string, quality_score int, steps array<{STEP}>, "
    f"selected_is_btp boolean, btp_components array<string>, checkpoint_request struct<selected_approach: string, naming_contract: array<{NAME}>, approach_options: array<{OPTION}>>"
)
#: The statuses that a step may have, and the steps that only the side-by-side variant has.
STATUSES = ("PASS", "FAIL", "RUNNING", "AWAITING_APPROVAL", "PENDING", "SKIPPED")
SIDE_STEPS = ("13", "14")
NO_NAMES = f"array<{NAME}>"


def contracted(steps: Column, contract: dict[str, dict[str, str]]) -> Column:
    """Steps with name, agent and gate as the contract has them for their number; an unknown status becomes PENDING, and a blank
    detail the contract's."""
    wanted = {n: F.struct(*[F.lit(spec[k]).alias(k) for k in ("name", "agent", "gate", "detail")]) for n, spec in contract.items()}

    def fixed(s: Column) -> Column:
        out = s
        for n, w in wanted.items():
            status = F.when(F.upper(s["status"]).isin(*STATUSES), s["status"]).otherwise("PENDING")
            detail = F.when(F.trim(F.coalesce(s["detail"], F.lit(""))) == "", w["detail"]).otherwise(s["detail"])
            step = F.struct(s["n"].alias("n"), w["name"].alias("name"), w["agent"].alias("agent"), w["gate"].alias("gate"), status.alias("status"), detail.alias("detail"))
            out = F.when(s["n"] == n, step).otherwise(out)
        return out

    return F.transform(steps, fixed)


def names_of(request: Column) -> Column:
    """The naming contract of a checkpoint request; where it has none, that of the option that would be picked."""
    options = request["approach_options"]
    names = lambda o: F.coalesce(o["naming_contract"], F.array().cast(NO_NAMES))
    short = F.transform(options, lambda o: F.struct(o["id"].alias("id"), F.coalesce(o["mandated"], F.lit(False)).alias("mandated"), o["feasible"].alias("feasible"), F.coalesce(o["recommended"], F.lit(False)).alias("recommended"), F.transform(names(o), lambda n: n["name"]).alias("names")))
    at = F.array_position(F.transform(short, lambda o: o["id"]), runs.picked_option(short, request["selected_approach"]))
    picked = F.when(at > 0, names(F.get(options, (at - 1).cast("int"))))
    own = F.coalesce(request["naming_contract"], F.array().cast(NO_NAMES))
    return F.when(request.isNotNull(), F.when(F.size(own) > 0, own).otherwise(F.coalesce(picked, own)))


def run_rows(bodies: DataFrame, contract: dict[str, dict[str, str]], files: DataFrame | None = None) -> DataFrame:
    """Runs from manifests (folder, body as JSON text) with side, workflow (canonical), steps (as shown), names, version, previous_run, run_count
    and files. Rows whose body is no JSON object go. `files`: folder and file, of which the manifest and hidden ones are left out.

    A run without id goes by its folder in its version chain; runs without source form a chain of their own.
    """
    m = bodies.select("folder", F.from_json("body", MANIFEST).alias("m")).where("m IS NOT NULL").select("folder", "m.*")
    m = m.where(F.coalesce(*[F.col(c).cast("string") for c in ("id", "title", "fd_source", "status", "workflow")], F.to_json("steps")).isNotNull())
    m = m.withColumn("side", runs.is_side_by_side(F.col("selected_is_btp"), F.col("btp_components"), F.col("mode")))
    shown = F.when(F.col("side"), contracted(F.col("steps"), contract)).otherwise(runs.visible_steps(F.col("steps"), F.lit(False), SIDE_STEPS))
    m = m.withColumns({"workflow": runs.workflow_label(F.col("workflow"), F.col("side")), "steps": shown, "names": names_of(F.col("checkpoint_request"))})
    chain = runs.run_history(m.withColumn("_run", F.coalesce("id", "folder")), "_run", "fd_source")
    out = chain.drop("_run", "checkpoint_request", "selected_is_btp", "btp_components")
    if files is None:
        return out
    kept = files.where((F.col("file") != "run.json") & ~F.col("file").startswith("."))
    listed = kept.groupBy("folder").agg(F.array_sort(F.collect_set("file")).alias("files"))
    return out.join(listed, "folder", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
