"""Queries of encodings, reports as text, state changes, service answers and candidate choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions import encoding as E
from foliolens.functions import geometry as G
from foliolens.functions import similarity as X
from foliolens.functions import text as T
from foliolens.functions.decisions import decision
from foliolens.operators.assignment import best_assignment
from foliolens.operators.places import with_places
from foliolens.operators.services import with_answers
from foliolens.operators.spatial import overlapping
from foliolens.plans.more import text_signals
from foliolens.plans.registry import query
from foliolens.sources import frames as S
from foliolens.sources.frames import with_frames
from foliolens.sources.shipping import ship

c = F.col


# Sources.
def files_under(spark, roots: list[str], explicit: list[str], pattern: str) -> DataFrame:
    """Paths named outright and those under the roots that fit a pattern, each once, in order; only metadata is read."""
    named = [spark.read.format("binaryFile").load(explicit)] if explicit else []
    below = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(roots)] if roots else []
    return reduce(DataFrame.union, [d.select("path") for d in named + below]).distinct().orderBy("path")


@query("s4_discover_manifests")
def s4(spark, folder):
    return files_under(spark, [folder], [f"{folder}/region.parquet"], "*.parquet")


@query("s5_manifest_objects", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s5(spark, folder):
    """Manifests with a fixed schema; a root that is no object is an error, not a null."""
    checked = F.when(F.ltrim("props").startswith("{"), c("props")).otherwise(F.raise_error(F.lit("a manifest must be a JSON object")))
    return S.table(spark, folder, "events").select("event_id", F.from_json(checked, "k bigint")["k"].alias("k"))


@query("s8_first_structure", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events ORDER BY event_id LIMIT 1")
def s8(spark, folder):
    """The structure of one job: the first by id, found without sorting the rest."""
    first = S.table(spark, folder, "events").agg(F.min(F.struct("event_id", "props")).alias("x"))
    return first.select("x.event_id", F.from_json("x.props", "map<string,string>")["k"].alias("k"))


# Reports as text.
def escaped(x: Column) -> Column:
    out = F.coalesce(x.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_row(*cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escaped(x), F.lit("</td>")) for x in cells], F.lit("</tr>"))


def _esc(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query("s12_html_summary", with_frames("jobs", f"""SELECT doc_id, '<tr><td>' || {_esc('source')} || '</td><td>' || CASE WHEN failed THEN 'failed' WHEN compliant THEN 'complete' ELSE 'needs_review' END || '</td><td>' || n_chars || '</td><td>' || coalesce(blocking::INT::VARCHAR, '0') || '</td></tr>' AS html FROM jobs"""))
def s12(spark, folder):
    """A summary row for each job: rows are rendered where they lie, and a writer may keep them as text."""
    status = F.when(c("failed"), "failed").when(c("compliant"), "complete").otherwise("needs_review")
    return S.jobs(spark, folder).select("doc_id", html_row(c("source"), status, c("n_chars"), F.coalesce(c("blocking").cast("int"), F.lit(0))).alias("html"))


@query("s13_markdown_report", with_frames("jobs", """SELECT source, '# Comparison' || chr(10) || chr(10) || '- Documents: `' || count(*) || '`' || chr(10) || '- Compliant: `' || count(*) FILTER (compliant) || '`' || chr(10) || '- Failed: `' || count(*) FILTER (failed) || '`' AS report FROM jobs GROUP BY source"""))
def s13(spark, folder):
    n = S.jobs(spark, folder).groupBy("source").agg(F.count(F.lit(1)).alias("all"), F.count_if("compliant").alias("good"), F.count_if("failed").alias("failed"))
    line = lambda name, x: F.concat(F.lit(f"- {name}: `"), c(x).cast("string"), F.lit("`"))  # noqa: E731
    return n.select("source", F.concat_ws("\n", F.lit("# Comparison"), F.lit(""), line("Documents", "all"), line("Compliant", "good"), line("Failed", "failed")).alias("report"))


@query("n24_step_result", "SELECT p_partkey, '{\"count\":' || p_size || ',\"approved\":' || p_size // 2 || ',\"rejected\":' || p_size % 2 || CASE WHEN p_size % 5 = 0 THEN ',\"reason\":\"no_figures\"' ELSE '' END || '}' AS result FROM part")
def n24(spark, folder):
    """A step's result; optional fields appear only where they have a value."""
    n = c("p_size")
    return S.table(spark, folder, "part").select("p_partkey", F.to_json(F.struct(
        n.alias("count"), F.floor(n / 2).cast("int").alias("approved"), (n % 2).alias("rejected"), F.when(n % 5 == 0, "no_figures").alias("reason"))).alias("result"))


# Encodings.
def _letters() -> Column:
    return F.transform(F.filter(F.split("p_name", ""), lambda x: x != ""), lambda x, i: F.struct((i + 1).alias("code"), x.alias("text")))


_CMAP = ("'" + "' || chr(10) || '".join([*E.CMAP_HEAD, "<0000> <FFFF>", "endcodespacerange"]) + "' || chr(10) || length(p_name) || ' beginbfchar' || chr(10) || array_to_string(list_transform(range(1, length(p_name) + 1), "
         "lambda i: '<' || printf('%04X', i) || '> <00' || hex(p_name[i]) || '>'), chr(10)) || chr(10) || 'endbfchar' || chr(10) || '" + "' || chr(10) || '".join(E.CMAP_TAIL) + "'")


@query("x19_cmap_text", f"SELECT p_partkey, {_CMAP} AS cmap FROM part")
def x19(spark, folder):
    """The letters of a name at codes 1, 2, … as the text of a character map."""
    return S.table(spark, folder, "part").select("p_partkey", E.cmap_text(_letters(), 2).alias("cmap"))


@query("x18_cmap_entries", "SELECT p_partkey, unnest(range(1, length(p_name) + 1)) AS code, unnest(string_split(p_name, '')) AS text, 0 AS unread FROM part")
def x18(spark, folder):
    """Entries of character maps, and how many can't be read."""
    ship(spark)
    maps = S.table(spark, folder, "part").select("p_partkey", E.read_cmap(E.cmap_text(_letters(), 2)).alias("x"))
    return maps.select("p_partkey", c("x.unread").alias("unread"), F.inline("x.entries"))


@query("p10_page_has_text", "SELECT p_partkey, regexp_matches('BT (' || p_name || ') ' || ['Tj', 'TJ', 'Tjx', 're f'][p_partkey % 4 + 1] || ' ET', '(Tj|TJ)\\b') AS has_text FROM part")
def p10(spark, folder):
    operator = F.element_at(F.array(*map(F.lit, ["Tj", "TJ", "Tjx", "re f"])), (c("p_partkey") % 4 + 1).cast("int"))
    stream = F.encode(F.concat(F.lit("BT ("), "p_name", F.lit(") "), operator, F.lit(" ET")), "ISO-8859-1")
    return S.table(spark, folder, "part").select("p_partkey", E.has_text_operator(F.decode(stream, "ISO-8859-1")).alias("has_text"))


@query("p53_unicode_policy", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'explicit' WHEN p_partkey % 4 = 0 THEN 'standard14' WHEN p_partkey % 4 IN (1, 2) AND p_size % 2 = 0 THEN 'embedded_cff' ELSE 'blocked' END AS policy FROM part""")
def p53(spark, folder):
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (c("p_partkey") % 4 + 1).cast("int"))  # noqa: E731
    policy = E.unicode_policy(c("p_size") % 5 == 0, pick("/Times-Roman", "/ABCDEF+Small", "/Other", "/Symbol"), pick("/TrueType", "/Type1", "/MMType1", "/TrueType"), c("p_size") % 2 == 0)
    return S.table(spark, folder, "part").select("p_partkey", policy.alias("policy"))


# Matching.
@query("x2_tie_break_similarity")
def x2(spark, folder):
    """The larger of the share of the longer text that the other fills, if it holds it, and the matching-blocks ratio."""
    gold = S.table(spark, folder, "benchmark").select(c("item_id").alias("conv_id"), T.normalized(c("text")).alias("a"))
    pairs = S.table(spark, folder, "conversations").select("conv_id", "turn", T.normalized(c("text")).alias("b")).join(gold, "conv_id")
    n, m = F.length("a"), F.length("b")
    held = F.when(F.contains("a", c("b")) | F.contains("b", c("a")), F.least(n, m) / F.greatest(n, m)).otherwise(0.0)
    score = F.when((n == 0) | (m == 0), 0.0).otherwise(F.greatest(held, c("sequence")))
    return X.with_similarity(pairs, "a", "b").select("conv_id", "turn", F.round(score, 6).alias("score"))


@query("j25_regions_to_elements")
def j25(spark, folder):
    """Text regions with text elements and image regions with figures, each kind assigned one to one by itself."""
    kind = lambda x: F.when(x % 3 == 0, "image").otherwise("text")  # noqa: E731
    pairs = overlapping(S.boxes(spark, folder)).where((c("box") % 2 == 0) & (c("o_box") % 2 == 1) & (kind(c("box")) == kind(c("o_box"))))
    scored = pairs.select(F.concat_ws(":", c("page").cast("string"), kind(c("box"))).alias("page"), c("box").alias("a"), c("o_box").alias("b"), G.iou(G.box(), G.box("o_")).alias("score"))
    found = best_assignment(scored)
    return found.select(F.split("page", ":")[1].alias("kind"), c("a").alias("region"), c("b").alias("element"), F.round("score", 6).alias("score"))


# State changes on tables: each is a new version of the rows, with what became of each request.
def claimed(jobs: DataFrame, key: str, status: str, wanted: Column, active: list[str]) -> DataFrame:
    """Jobs that are asked for and not active become ``processing``; ``claim`` tells claimed, refused, or null where none asked."""
    claim = F.when(wanted, F.when(c(status).isin(active), "refused").otherwise("claimed"))
    return jobs.select(key, F.when(claim == "claimed", "processing").otherwise(c(status)).alias(status), claim.alias("claim"))


@query("m8_claim_jobs", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus NOT IN ('O', 'P') THEN 'processing' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderstatus IN ('O', 'P') THEN 'refused' ELSE 'claimed' END END AS claim FROM orders")
def m8(spark, folder):
    return claimed(S.table(spark, folder, "orders"), "o_orderkey", "o_orderstatus", c("o_orderkey") % 2 == 0, ["O", "P"])


@query("m10_resolve_tasks", with_frames("review_tasks", "SELECT e.event_id, CASE WHEN t.task_id IS NULL THEN 404 WHEN blocking OR row_number() OVER (PARTITION BY t.task_id ORDER BY e.event_id) > 1 THEN 409 ELSE 200 END AS code FROM events e LEFT JOIN review_tasks t ON t.task_id = e.user_id"))
def m10(spark, folder):
    """Requests to resolve tasks, in order: the first for an open task resolves it, later ones meet a conflict.

    Only the least request of a task matters, so a hot task is a pre-aggregated minimum and no window over its requests.
    """
    asked = S.table(spark, folder, "events").select("event_id", c("user_id").alias("task_id"))
    first = asked.groupBy("task_id").agg(F.min("event_id").alias("first"))
    tasks = S.review_tasks(spark, folder).select("task_id", "blocking").join(first, "task_id")
    return asked.join(tasks, "task_id", "left").select("event_id", F.when(c("first").isNull(), 404).when(c("blocking") | (c("event_id") > c("first")), 409).otherwise(200).alias("code"))


@query("m11_pending_migrations", "SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey))::BIGINT - 1 AS step FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier) AND p_size = 50")
def m11(spark, folder):
    """Steps that haven't been applied, with their order among them."""
    pending = S.table(spark, folder, "part").where("p_size = 50").select("p_partkey").join(S.table(spark, folder, "supplier").select(c("s_suppkey").alias("p_partkey")), "p_partkey", "left_anti")
    return with_places(pending, "p_partkey").select("p_partkey", c("place").alias("step"))


@query("m1_admitted_submissions", with_frames("job_steps", "SELECT event_id, job_id, (lag(step) OVER w IS NOT NULL AND lag(step) OVER w = step) AS duplicate FROM job_steps WINDOW w AS (PARTITION BY job_id ORDER BY pos)"))
def m1(spark, folder):
    """A submission is a duplicate while the one before it, of the same job and step, is still under way."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("event_type").over(w)
    return S.table(spark, folder, "events").select("event_id", c("user_id").alias("job_id"), F.coalesce(before == c("event_type"), F.lit(False)).alias("duplicate"))


# Service answers.
def _read_aloud(rows) -> list[dict]:
    """A stand-in for a service: the first word and the length of a text."""
    return [{"label": (t or "").split(" ")[0], "chars": len(t or "")} for t in rows["text"]]


@query("e5_figure_answers", "SELECT page_id AS page, page_id % 4 AS pos, string_split(url, ' ')[1] AS label, length(url)::INT AS chars, NULL::VARCHAR AS problem FROM pages")
def e5(spark, folder):
    rows = S.table(spark, folder, "pages").select(c("page_id").alias("page"), (c("page_id") % 4).alias("pos"), c("url").alias("text"))
    return with_answers(rows, "page", "pos", _read_aloud, "label string, chars int")


@query("e6_form_answers", "SELECT p_partkey // 10 AS page, p_partkey % 10 AS pos, string_split(p_name, ' ')[1] AS label, length(p_name)::INT AS chars, NULL::VARCHAR AS problem FROM part")
def e6(spark, folder):
    rows = S.table(spark, folder, "part").select(F.floor(c("p_partkey") / 10).alias("page"), (c("p_partkey") % 10).alias("pos"), c("p_name").alias("text"))
    return with_answers(rows, "page", "pos", _read_aloud, "label string, chars int")


@query("e7_table_answers", with_frames("table_cells", "SELECT tbl AS page, col AS pos, text AS label, length(text)::INT AS chars, NULL::VARCHAR AS problem FROM table_cells"))
def e7(spark, folder):
    rows = S.table_cells(spark, folder).select(c("tbl").alias("page"), c("col").alias("pos"), "text")
    return with_answers(rows, "page", "pos", _read_aloud, "label string, chars int")


def _fails_on_sevens(rows) -> list[dict]:
    if (rows["page"] % 7 == 0).any():
        raise TimeoutError("busy")
    return _read_aloud(rows)


@query("e10_failed_answers", "SELECT conv_id AS page, turn AS pos, CASE WHEN conv_id % 7 <> 0 THEN length(text)::INT END AS chars, CASE WHEN conv_id % 7 = 0 THEN 'TimeoutError: busy' END AS problem FROM conversations")
def e10(spark, folder):
    """Rows whose batch failed at every attempt have nulls and the reason; the others go on."""
    return with_answers(S.blocks(spark, folder).select("page", "pos", "text"), "page", "pos", _fails_on_sevens, "chars int", attempts=2)


@query("e8_semantic_decision", """SELECT p_partkey::VARCHAR AS unit_id, 'table' AS unit_type, p_name AS summary, CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CASE p_size % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence_score,
    CASE WHEN p_size % 2 = 0 THEN 'set_table_headers' ELSE 'manual_only' END AS suggested_action, NULL::VARCHAR AS resolved_text, '0,' || (p_size + 1) AS header_rows, p_size % 4 = 0 AS is_toc FROM part""")
def e8(spark, folder):
    label = F.element_at(F.array(F.lit(" High "), F.lit("medium"), F.lit("sure")), c("p_size") % 3 + 1)
    verdict = F.to_json(F.struct(
        F.concat(F.lit(" "), "p_name").alias("summary"), label.alias("confidence"), F.when(c("p_size") % 2 == 0, "set_table_headers").alias("suggested_action"), F.lit("  ").alias("resolved_text"),
        F.array(c("p_size") + 1, F.lit(0), F.lit(-1), F.lit(0)).alias("header_rows"), F.when(c("p_size") % 4 == 0, True).alias("is_toc")))
    d = S.table(spark, folder, "part").select(decision(c("p_partkey").cast("string"), F.lit("table"), verdict).alias("d")).select("d.*")
    return d.select("unit_id", "unit_type", "summary", "confidence", "confidence_score", "suggested_action", "resolved_text", F.concat_ws(",", F.transform("header_rows", lambda x: x.cast("string"))).alias("header_rows"), "is_toc")


@query("e18_dispatch", with_frames("review_tasks", "SELECT task_id, CASE task_type WHEN 'font_text_fidelity' THEN 'font' WHEN 'reading_order' THEN 'order' ELSE 'table' END AS lane, severity FROM review_tasks WHERE task_type IN ('font_text_fidelity', 'reading_order', 'table_semantics')"))
def e18(spark, folder):
    """Tasks by lane: a union of filtered lanes, each of which may go its own way."""
    tasks = S.review_tasks(spark, folder).select("task_id", "task_type", "severity")
    lanes = {"font_text_fidelity": "font", "reading_order": "order", "table_semantics": "table"}
    return reduce(DataFrame.unionByName, [tasks.where(c("task_type") == t).select("task_id", F.lit(lane).alias("lane"), "severity") for t, lane in lanes.items()])


@query("e20_readiness", with_frames("jobs", "SELECT source, CASE WHEN bool_and(NOT failed) THEN 'ready' ELSE 'not_ready' END AS status, count(*) FILTER (failed) AS failing FROM jobs GROUP BY source"))
def e20(spark, folder):
    return S.jobs(spark, folder).groupBy("source").agg(F.when(F.bool_and(~c("failed")), "ready").otherwise("not_ready").alias("status"), F.count_if("failed").alias("failing"))


# Choice among candidates, one after the other.
def climbed(candidates: DataFrame, key: str, order: str, cost: str) -> DataFrame:
    """Candidates in order, kept where they cost less than the best kept so far: less than all before, since what is rejected costs no less."""
    w = Window.partitionBy(key).orderBy(order)
    least = F.min(cost).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return candidates.withColumn("accepted", least.isNull() | (c(cost) < least))


_CLIMB = "coalesce({cost} < min({cost}) OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)"


@query("e14_font_lane_choice", f"SELECT o_custkey, o_orderkey, {_CLIMB.format(cost='o_totalprice', key='o_custkey', order='o_orderkey')} AS accepted FROM orders")
def e14(spark, folder):
    rows = S.table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return climbed(rows, "o_custkey", "o_orderkey", "o_totalprice").drop("o_totalprice")


@query("e19_keep_if_not_worse", "SELECT l_orderkey, l_linenumber, max(l_quantity) <= min(l_extendedprice) / 1000 AS kept FROM lineitem GROUP BY ALL")
def e19(spark, folder):
    """A change stays where no count after it is worse than before."""
    rows = S.table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("after"), F.min("l_extendedprice").alias("before"))
    return rows.select("l_orderkey", "l_linenumber", (c("after") <= c("before") / 1000).alias("kept"))


@query("e13_auto_apply", with_frames("review_tasks", """SELECT job_id, count(*) FILTER (NOT (blocking AND task_type IN ('reading_order', 'table_semantics') AND severity = 'high')) AS remaining,
    coalesce(string_agg(task_id::VARCHAR, ',' ORDER BY task_id) FILTER (blocking AND task_type IN ('reading_order', 'table_semantics') AND severity = 'high'), '') AS applied FROM review_tasks GROUP BY job_id"""))
def e13(spark, folder):
    """Blocking structure tasks with a sure answer are applied in order; the rest remains."""
    sure = c("blocking") & c("task_type").isin("reading_order", "table_semantics") & (c("severity") == "high")
    rows = S.review_tasks(spark, folder).groupBy("job_id").agg(F.count_if(~sure).alias("remaining"), F.array_sort(F.collect_list(F.when(sure, c("task_id")))).alias("ids"))
    return rows.select("job_id", "remaining", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("applied"))


# Texts read again.
#: A reading that differs from the block's text by less than this is no news.
SAME_TEXT = 0.97
LEAST_CHARS, LEAST_READ_CHARS = 6, 3


def grounded_candidates(blocks: DataFrame) -> DataFrame:
    """Suspicious blocks (page, pos, role, text, ocr) that a second reading tells differently, worst first.

    The reading may not hold far more than the block, nor also its neighbours' text. The
    result has the neighbours' texts and roles, the signals, the kind of issue and the
    similarity. A null text or reading counts as empty and gives no candidate.
    """
    w = Window.partitionBy("page").orderBy("pos")
    near = {f"{side}_{n}": F.coalesce(f(n).over(w), F.lit("")) for side, f in (("previous", F.lag), ("next", F.lead)) for n in ("text", "role")}
    rows = blocks.withColumns(near).withColumn("signals", text_signals(T.collapsed(c("text"))))
    rows = rows.where((c("signals") != "") & (c("role") != "artifact") & (F.length(T.collapsed(c("text"))) >= LEAST_CHARS))
    rows = rows.withColumns({n: T.dense(c(x)) for n, x in (("_a", "text"), ("_b", "ocr"), ("_p", "previous_text"), ("_n", "next_text"))})
    a, b = F.length("_a"), F.length("_b")
    also = lambda x: (c(x) != "") & F.contains("_b", c(x))  # noqa: E731
    wide = (b > a + 20) & F.contains("_b", c("_a"))
    spread = (b > F.greatest(2 * a, a + 40)) & (also("_p") | also("_n"))
    rows = rows.where((a > 0) & (b >= LEAST_READ_CHARS) & ~wide & ~spread & (T.normalized(c("text")) != T.normalized(c("ocr"))))
    scored = X.with_similarity(rows, "text", "ocr", "indel").where((c("indel") < SAME_TEXT) | F.contains("signals", F.lit("spaced letters")))
    issue = F.when(c("_a") == c("_b"), "spacing_only").otherwise("encoding_problem")
    return scored.select(*blocks.columns, *near, "signals", issue.alias("issue_type"), F.round("indel", 4).alias("similarity")).orderBy("issue_type", "page", "pos")


@query("w18_grounded_candidates")
def w18(spark, folder):
    """Turns whose letters stand apart, against what they say when read together."""
    spaced = F.when(c("turn") % 2 == 0, F.trim(F.regexp_replace("text", "(.)", "$1 "))).otherwise(c("text"))
    blocks = S.table(spark, folder, "conversations").select(c("conv_id").alias("page"), c("turn").alias("pos"), "role", spaced.alias("text"), c("text").alias("ocr"))
    return grounded_candidates(blocks).select("page", "pos", "signals", "issue_type", "similarity", F.length("previous_text").alias("previous_chars"), F.length("next_text").alias("next_chars"))


#: A line of code has one of these.
CODE_MARKS = r"\b(def|for|if|return|class|with|import)\b|[#=\[\](){}:]"
LEAST_CODE_SUPPORT = 0.55
MOST_CODE_LINES, MOST_CODE_CHARS = 40, 2000


def code_accepted(blocks: DataFrame) -> DataFrame:
    """Blocks (role, confidence, blocking, issue_type, hint, native, ocr) with ``accepted``: the hint reads as code and one of the readings bears it out."""
    lines = F.filter(F.split("hint", r"\R"), lambda x: F.trim(x) != "")
    marked = F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(CODE_MARKS))))
    code = F.size(lines).between(2, MOST_CODE_LINES) & (F.length("hint") <= MOST_CODE_CHARS) & (marked >= 2)
    asked = (c("role") == "code") & (c("confidence") == "high") & c("blocking") & (c("issue_type") == "encoding_problem") & code
    native = X.with_similarity(blocks, "hint", "native", "indel").withColumnRenamed("indel", "_native")
    both = X.with_similarity(native, "hint", "ocr", "indel").withColumn("accepted", F.coalesce(asked & (F.greatest("_native", "indel") >= LEAST_CODE_SUPPORT), F.lit(False)))
    return both.select(*blocks.columns, "accepted")


@query("p34_code_accepted", "SELECT p_partkey, p_size % 3 <> 0 AND p_partkey % 2 = 0 AS accepted FROM part")
def p34(spark, folder):
    code = F.concat(F.lit("def part():\n    return '"), c("p_name"), F.lit("'"))
    blocks = S.table(spark, folder, "part").select(
        "p_partkey", F.lit("code").alias("role"), F.when(c("p_size") % 3 == 0, "low").otherwise("high").alias("confidence"), F.lit(True).alias("blocking"), F.lit("encoding_problem").alias("issue_type"),
        F.when(c("p_partkey") % 2 == 0, code).otherwise(c("p_name")).alias("hint"), F.lit("").alias("native"), F.replace(code, F.lit(" "), F.lit("")).alias("ocr"))
    return code_accepted(blocks).select("p_partkey", "accepted")


# Fixed values: frequent words of each language.
FREQUENT_WORDS = {
    "en": "the of and to a in is that for it was on with be as by are this at",
    "fr": "de la le et les des en un une du que pour est qui dans par pas au sur avec",
    "de": "der die und in den von zu das sich mit auf des für ist im dem nicht ein er eine als",
    "es": "de la que el en y los se del las por un no con su una es para al",
}
LEAST_WORDS = 8


def frequent_word_language(text: Column) -> Column:
    """The language whose frequent words make up most of a text; null below eight words or without any of them. Ties go to the first by name."""
    words = F.concat(F.lit(" "), F.lower(T.collapsed(text)), F.lit(" "))
    count = lambda known: F.regexp_count(words, F.lit(f"(?<= )(?:{known.replace(' ', '|')})(?= )"))  # noqa: E731
    hits = F.array(*[F.struct((-count(known)).alias("n"), F.lit(lang).alias("lang")) for lang, known in FREQUENT_WORDS.items()])
    best = F.array_min(hits)
    return F.when((T.word_count(text) >= LEAST_WORDS) & (best["n"] < 0), best["lang"])


_HITS = ", ".join(f"{{'n': -len(list_filter(w, lambda x: x IN ({', '.join(f"'{x}'" for x in known.split())}))), 'lang': '{lang}'}}" for lang, known in FREQUENT_WORDS.items())


@query("f17_detected_language", rf"""SELECT doc_id, CASE WHEN len(w) >= 8 AND best.n < 0 THEN best.lang END AS lang FROM (SELECT doc_id, w, list_min([{_HITS}]) AS best FROM (
    SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[ 	

]+', ' ', 'g')), ' ') AS w FROM documents))""")
def f17(spark, folder):
    return S.table(spark, folder, "documents").select("doc_id", frequent_word_language(c("text")).alias("lang"))
