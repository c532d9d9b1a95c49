"""Queries of similarity measures, repairs, trees of JSON, folds and whole comparisons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliolens.functions import similarity as X
from foliolens.functions import text as T
from foliolens.operators.drift import text_drift
from foliolens.plans.registry import query
from foliolens.plans.scalars import _n
from foliolens.sources import frames as S
from foliolens.sources.frames import with_frames
from foliolens.sources.shipping import ship
from foliolens.streaming.events import sessions

c = F.col

#: Text drift is measured on a sample of at most so many characters.
SAMPLE_CHARS = 20_000


@query("s7_ordered_projection", "SELECT conv_id, turn, role FROM conversations WHERE role <> 'system' ORDER BY conv_id, turn")
def s7(spark, folder):
    return S.table(spark, folder, "conversations").where("role <> 'system'").select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@query("s2_discover_files")
def s2(spark, folder):
    """Files of a folder tree by path, each once, newest first; only metadata is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return files.select("path", "length", "modificationTime").dropDuplicates(["path"]).orderBy(F.desc("modificationTime"), "path")


@query("g34_best_toc_label", with_frames("review_tasks", "SELECT task_type, arg_max(severity, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS best FROM review_tasks WHERE NOT blocking GROUP BY task_type"))
def g34(spark, folder):
    rank = F.when(c("severity") == "high", 3).when(c("severity") == "medium", 2).otherwise(1)
    return S.review_tasks(spark, folder).where(~c("blocking")).groupBy("task_type").agg(F.max_by("severity", rank).alias("best"))


@query("t4_benchmark_regressions", "SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 0 AND p_partkey % 6 = 0 THEN 'to_zero' END, CASE WHEN p_size % 4 > p_partkey % 4 THEN 'links' END) AS regressions FROM part")
def t4(spark, folder):
    return S.table(spark, folder, "part").select("p_partkey", F.concat_ws(",", F.when((c("p_size") > 0) & (c("p_partkey") % 6 == 0), "to_zero"), F.when(c("p_size") % 4 > c("p_partkey") % 4, "links")).alias("regressions"))


@query("t8_combine_sources")
def t8(spark, folder):
    """Second-source entries join the first unless their (text, page) or section was seen: a fold, since each choice counts for the next. A document's entries are a bounded group."""
    rows = S.table(spark, folder, "part").select(
        F.floor(c("p_partkey") / 40).alias("doc"), "p_partkey", (c("p_partkey") % 2).alias("second"), F.concat_ws("@", "p_name", (c("p_size") % 3).cast("string")).alias("text"),
        F.when(c("p_size") % 2 == 0, (c("p_size") % 10).cast("string")).otherwise("").alias("section"))
    listed = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("second", "p_partkey", "text", "section"))).alias("a"))
    empty = F.expr("named_struct('kept', cast(array() as array<bigint>), 'texts', cast(array() as array<string>), 'sections', cast(array() as array<string>))")

    def step(s, x):
        seen = (x["second"] == 1) & (F.array_contains(s["texts"], x["text"]) | ((x["section"] != "") & F.array_contains(s["sections"], x["section"])))
        return F.when(seen, s).otherwise(F.struct(
            F.array_append(s["kept"], x["p_partkey"]).alias("kept"), F.array_append(s["texts"], x["text"]).alias("texts"), F.array_append(s["sections"], x["section"]).alias("sections")))

    return listed.select("doc", F.posexplode(F.aggregate("a", empty, step)["kept"]).alias("place", "p_partkey"))


@query("t14_tree_bookmarks", "SELECT r_regionkey AS page, 1 AS level, r_name AS title FROM region UNION ALL SELECT n_regionkey, 2, n_name FROM nation WHERE n_name <> ''")
def t14(spark, folder):
    S.table(spark, folder, "region").createOrReplaceTempView("_toc_region")
    S.table(spark, folder, "nation").createOrReplaceTempView("_toc_nation")
    return spark.sql("""WITH RECURSIVE toc AS (SELECT r_regionkey AS page, 1 AS level, r_name AS title FROM _toc_region
        UNION ALL SELECT page, level + 1, n_name FROM _toc_nation JOIN toc ON n_regionkey = page AND level = 1 WHERE n_name <> '') SELECT page, level, title FROM toc""")


@query("n4_resolve_pointer", "SELECT event_id, json_extract_string(props, '$.k') AS value FROM events")
def n4(spark, folder):
    pointer = F.lit("#/k")
    return S.table(spark, folder, "events").select("event_id", F.call_function("get_json_object", c("props"), F.concat(F.lit("$"), F.regexp_replace(F.regexp_replace(pointer, "^#", ""), "/", "."))).alias("value"))


@query("n6_prune_tree", "SELECT r_regionkey, count(n_nationkey) AS children FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey % 2 = 0 GROUP BY r_regionkey HAVING count(n_nationkey) > 0")
def n6(spark, folder):
    kept = S.table(spark, folder, "nation").where("n_nationkey % 2 = 0").groupBy(c("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("children"))
    return S.table(spark, folder, "region").select("r_regionkey").join(kept, "r_regionkey")


@query("n9_two_reports", with_frames("violations", "SELECT event_id, rule_id, count, severity = 'warning' AS compliant FROM violations"))
def n9(spark, folder):
    """Reports of two schemas read to one: the older names the rule id, the newer its parts."""
    v = S.violations(spark, folder)
    report = F.when(c("event_id") % 2 == 0, F.to_json(F.struct(c("rule_id").alias("ruleId"), c("count").alias("failedChecks")))).otherwise(F.to_json(F.struct(F.struct(c("rule_id").alias("rule"), c("count").alias("n")).alias("summary"))))
    read = lambda old, new: F.coalesce(F.get_json_object(report, old), F.get_json_object(report, new))
    return v.select("event_id", read("$.ruleId", "$.summary.rule").alias("rule_id"), read("$.failedChecks", "$.summary.n").cast("bigint").alias("count"), (c("severity") == "warning").alias("compliant"))


@query("n21_merge_metadata", with_frames("review_tasks", "SELECT job_id, task_id, CASE WHEN row_number() OVER (PARTITION BY job_id ORDER BY task_id) = 1 THEN severity || '+merged' ELSE severity END AS note FROM review_tasks WHERE task_type = 'alt_text'"))
def n21(spark, folder):
    first = F.row_number().over(Window.partitionBy("job_id").orderBy("task_id")) == 1
    return S.review_tasks(spark, folder).where("task_type = 'alt_text'").select("job_id", "task_id", F.when(first, F.concat("severity", F.lit("+merged"))).otherwise(c("severity")).alias("note"))


@query("n23_font_summary", "SELECT p_partkey, p_name AS summary, p_type AS confidence FROM part")
def n23(spark, folder):
    kept = F.map_filter(F.create_map(F.lit("summary"), "p_name", F.lit("confidence"), "p_type", F.lit("raw"), "p_brand"), lambda k, v: k.isin("summary", "confidence"))
    return S.table(spark, folder, "part").select("p_partkey", kept["summary"].alias("summary"), kept["confidence"].alias("confidence"))


@query("n25_safe_json", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), -1) ELSE -1 END AS k FROM events")
def n25(spark, folder):
    raw = F.when(c("event_id") % 2 == 0, c("props")).otherwise("{bad")
    return S.table(spark, folder, "events").select("event_id", F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$.k", "int"), F.lit(-1)).alias("k"))


@query("g39_status_counts", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def g39(spark, folder):
    """Values of ``status`` at any depth of a JSON text; here one flat and one nested form."""
    flat, deep = F.to_json(F.struct(c("event_type").alias("status"))), F.to_json(F.struct(F.struct(c("event_type").alias("status")).alias("inner")))
    doc = F.when(c("event_id") % 2 == 0, flat).otherwise(deep)
    return S.table(spark, folder, "events").select(F.explode(F.regexp_extract_all(doc, F.lit(r'"status":"([^"]*)"'), F.lit(1))).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("e2_extract_structure", with_frames("page_elements", "SELECT doc, count(*) AS elements, count(*) FILTER (type = 'heading') AS headings, max(pos)::INT AS last_pos, min(CASE WHEN type = 'title' THEN pos END)::INT AS title_pos FROM page_elements GROUP BY doc"))
def e2(spark, folder):
    return S.page_elements(spark, folder).groupBy("doc").agg(F.count(F.lit(1)).alias("elements"), F.count_if(c("type") == "heading").alias("headings"), F.max("pos").alias("last_pos"), F.min(F.when(c("type") == "title", c("pos"))).alias("title_pos"))


@query("e4_caption_fallback", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Figure: ' || p_name WHEN p_size % 3 = 1 THEN p_brand ELSE '[figure]' END AS alt FROM part")
def e4(spark, folder):
    """Without a describing service: a caption, else a label, else a placeholder."""
    caption = F.when(c("p_size") % 3 == 0, F.concat(F.lit("Figure: "), c("p_name")))
    return S.table(spark, folder, "part").select("p_partkey", F.coalesce(caption, F.when(c("p_size") % 3 == 1, c("p_brand")), F.lit("[figure]")).alias("alt"))


@query("e17_round_trip", f"""SELECT doc_id, {_n('text')} = {_n("replace(text, chr(10), ' ')")} AS same_text, length({_n('text')})::INT AS chars FROM documents""")
def e17(spark, folder):
    """A document and the same with its line breaks lost: the normalized texts agree."""
    a, b = T.normalized(c("text")), T.normalized(F.regexp_replace("text", "\n", " "))
    return S.table(spark, folder, "documents").select("doc_id", (a == b).alias("same_text"), F.length(a).alias("chars"))


@query("m2_step_sessions")
def m2(spark, folder):
    """Sessions of users by event time; a stream runs the same with a watermark."""
    return sessions(S.table(spark, folder, "events"))


def _mapped(spark, folder, name: str, kind: str, fn):
    ship(spark)
    return S.table(spark, folder, "conversations").select("conv_id", "turn", X.mapped(kind, fn)("text").alias(name))


@query("f4_repaired_text")
def f4(spark, folder):
    return _mapped(spark, folder, "repaired", "string", X.repaired)


@query("f22_spaced_caps", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'ABC ' || p_size::VARCHAR || ' x' ELSE p_name END AS title FROM part")
def f22(spark, folder):
    """Capitals set apart by blanks are one word, numbers after them stay apart."""
    raw = F.when(c("p_size") % 2 == 0, F.concat(F.lit("A B C "), c("p_size").cast("string"), F.lit(" x"))).otherwise(c("p_name"))
    return S.table(spark, folder, "part").select("p_partkey", F.regexp_replace(raw, r"(?<=\b[A-Z])\s+(?=[A-Z]\b)", "").alias("title"))


@query("f30_fragments_joined")
def f30(spark, folder):
    return _mapped(spark, folder, "joined", "string", X.fragments_joined)


@query("f33_scripts")
def f33(spark, folder):
    return _mapped(spark, folder, "scripts", "string", lambda t: ",".join(sorted({s for s in map(X.script_of, t or "") if s})))


_GREEK = {"α": "alpha", "β": "beta", "π": "pi", "Σ": "capital sigma"}  # Fixed values: symbols and their names.


@query("f34_formula_text", "SELECT p_partkey, 'alpha x power ' || p_size::VARCHAR || ' plus y sub ' || (p_partkey % 10)::VARCHAR AS spoken FROM part")
def f34(spark, folder):
    out = F.concat(F.lit("αx^{"), c("p_size").cast("string"), F.lit("}+y_"), (c("p_partkey") % 10).cast("string"))
    for symbol, word in _GREEK.items():
        out = F.replace(out, F.lit(symbol), F.lit(f" {word} "))
    out = F.regexp_replace(out, r"([A-Za-z0-9)])\s*\^\s*\{?([A-Za-z0-9]+)\}?", "$1 power $2")
    out = F.regexp_replace(out, r"([A-Za-z0-9)])\s*_\s*\{?([A-Za-z0-9]+)\}?", "$1 sub $2")
    return S.table(spark, folder, "part").select("p_partkey", T.collapsed(F.replace(out, F.lit("+"), F.lit(" plus "))).alias("spoken"))


@query("x1_preservation")
def x1(spark, folder):
    """Share of a turn's characters kept by the passage of its conversation."""
    ship(spark)
    gold = S.table(spark, folder, "benchmark").select(c("item_id").alias("conv_id"), c("text").alias("a"))
    pairs = S.table(spark, folder, "conversations").select("conv_id", "turn", c("text").alias("b")).join(gold, "conv_id")

    def both(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(X.preservation(p or "", q or ""), 6) for p, q in zip(a, b, strict=True)], dtype="float64")

    return pairs.select("conv_id", "turn", F.pandas_udf(both, "double")("a", "b").alias("preserved"))


@query("x3_text_drift")
def x3(spark, folder):
    """Each document's sample (its first SAMPLE_CHARS, the operator's own rule) and one changed by a rule of its id: measures and verdict by kind.

    Changes: every fifth word lost, words added at the end, a quarter cut off, none. Every
    third document has another text that the source took the place of.
    """
    sample, k = F.substring("text", 1, SAMPLE_CHARS), c("doc_id") % 4
    lost = F.regexp_replace(sample, r"(\S+\s+\S+\s+\S+\s+\S+\s+)\S+\s*", "$1")
    cut = F.expr(f"left(text, least(length(text), {SAMPLE_CHARS}) * 3 div 4)")
    output = F.when(k == 0, lost).when(k == 1, F.concat(sample, F.lit(" "), F.substring("source", 1, 20))).when(k == 2, cut).otherwise(sample)
    kind = F.element_at(F.array(*map(F.lit, ("digital", "scanned", "mixed"))), (F.floor(c("doc_id") / 4) % 3 + 1).cast("int"))
    pairs = S.spread(S.table(spark, folder, "documents"), "doc_id").select(
        "doc_id", sample.alias("source"), output.alias("output"), F.when(c("doc_id") % 3 == 0, lost).alias("original"), kind.alias("classification"))
    return text_drift(pairs).select(
        "doc_id", "classification", *[F.round(m, 6).alias(m) for m in ("similarity", "length_ratio", "containment", "preservation", "original_similarity", "original_length_ratio")], "status", "rescue_review")


@query("p33_encoding_blocks")
def p33(spark, folder):
    """Blocks whose readable text is near enough (0.94) to the original and short enough to put in its place."""
    pairs = S.table(spark, folder, "part").select("p_partkey", c("p_name").alias("a"), F.when(c("p_size") % 2 == 0, F.regexp_replace("p_name", "i", "l")).otherwise(c("p_name")).alias("b"))
    scored = X.with_similarity(pairs, "a", "b", "indel")
    return scored.select("p_partkey", ((c("indel") >= 0.94) & (F.length("b") <= 128) & (F.size(F.split("b", " ")) <= 10)).alias("apply"))


@query("p35_artifact_blocks")
def p35(spark, folder):
    """Blocks unlike their own hint but like their neighbour: repeats of what stands beside them."""
    w = Window.partitionBy("page").orderBy("pos")
    near = S.blocks(spark, folder).select("page", "pos", c("text").alias("a"), F.coalesce(F.lag("text").over(w), F.lit("")).alias("b"))
    return X.with_similarity(near, "a", "b", "indel").select("page", "pos", (c("indel") >= 0.9).alias("artifact"))
