"""Reading replies: cleaning, extraction, probabilities, dates, event XML."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import answers, dates, text
from ledgerline.plans.register import query
from ledgerline.shipping import ship
from ledgerline.sources import readers

r6 = lambda c: F.round(c, 6)
big = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")
MAPPING = {"0": "no", "1": "yes", "2": "of"}


@query("conversations", sql=r"""
    WITH c AS (SELECT conv_id, turn, role, 'The answer is  "' || regexp_extract(text, '^\s*(\S+)', 1) || '"  [TRUNCATED 12 chars] ' AS a, text FROM conversations),
    d AS (SELECT *, trim(regexp_replace(regexp_replace(trim(regexp_replace(trim(a), '^the answer is\s*', '', 'i')), '\s+', ' ', 'g'), '\s*\[TRUNCATED.*?\]\s*$', '', 'i')) AS cleaned FROM c)
    SELECT role, count(*) AS n, count(DISTINCT cleaned) AS answers, count(*) FILTER (WHERE regexp_matches(text, 'unable to|cannot provide', 'i')) AS refusals,
           sum(len(trim(regexp_split_to_array('Q ' || turn || ' OPTIONS A: x', '\bOPTIONS\b')[1])))::BIGINT AS question_chars,
           count(*) FILTER (WHERE CASE lower(regexp_extract(text, '^\s*(\S+)', 1)) WHEN 'of' THEN '2' END = (turn % 3)::VARCHAR) AS right_label FROM d GROUP BY role""")
def q36_answer_clean(conversations):
    """The cleaning chain, option letters, question text, refusals and the way back from answer to label."""
    word = F.regexp_extract("text", r"^\s*(\S+)", 1)
    a = F.concat(F.lit('The answer is  "'), word, F.lit('"  [TRUNCATED 12 chars] '))
    question = text.clean_question(F.concat(F.lit("Q "), F.col("turn").cast("string"), F.lit(" OPTIONS A: x")))
    rows = conversations.select("role", text.clean_answer(a).alias("cleaned"), answers.is_refusal(F.col("text"), F.lit(None).cast("string")).alias("refused"), question.alias("q"), (answers.label_of(text.strip_option(word), {"2": "of"}) == answers.normal_label(F.col("turn") % 3)).alias("right"))
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cleaned").alias("answers"), F.count_if("refused").alias("refusals"), big(F.sum(F.length("q"))).alias("question_chars"), F.count_if("right").alias("right_label"))


@query("conversations", sql=r"""
    WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM conversations), c AS (SELECT conv_id, turn, ws[1] AS a, ws[2] AS b FROM w WHERE len(ws) > 1)
    SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN '\text{' || a || '} ' || b WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN 'all' WHEN 4 THEN b ELSE a || ' ' || b END AS answer, turn % 2 = 0 AS correct FROM c""")
def q37_answer_extract(conversations):
    """The answer that comes first, and whether any candidate is the gold answer, in replies of six forms around the first
    two words of each text: boxed, behind an empty tag, in brackets behind a pipe, a sentence, several pipes, a label."""
    ship(conversations.sparkSession)
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    rows = conversations.select("conv_id", "turn", ((F.col("conv_id") + F.col("turn")) % 6).alias("form"), F.get(words, F.lit(0)).alias("a"), F.get(words, F.lit(1)).alias("b")).where("b IS NOT NULL")
    replies = [r"'so \\boxed{\\text{' || a || '} ' || b || '} fine'", "'<answer></answer> ' || a", """a || ' | <"' || b || '">'""", "a || ' is ' || b || ' of all'", "'no ' || a || ' | ' || a || ' | ' || b", "'<b> <label>the answer is ' || a || '  ' || b || ' [truncated 3]</label> x'"]
    golds = [r"'\\text{' || a || '} ' || b", "a", "a", "a || ' is ' || b || ' of all'", "'no ' || a", "a || ' ' || b"]
    form = lambda cases: F.expr("CASE form " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END")
    asked = rows.select("conv_id", "turn", form(replies).alias("reply"), F.when(F.col("turn") % 2 == 0, form(golds)).otherwise("not in it").alias("gold"))
    return asked.select("conv_id", "turn", answers.primary(F.col("reply")).alias("answer"), answers.any_correct(F.col("reply"), F.upper("gold")).alias("correct"))


@query("pages", sql=r"""
    SELECT page_id, trim(regexp_extract(html, '<title\s*>(.+?)</title\s*>', 1, 'is')) AS title, len(regexp_extract_all(html, '<a href=')) AS links FROM pages""")
def q38_tag_extract(pages):
    """Title and number of links."""
    return pages.select("page_id", text.tag(F.col("html"), "title").alias("title"), big(F.regexp_count("html", F.lit("<a href="))).alias("links"))


@query("events", sql="""
    WITH e AS (SELECT event_type, (props->>'$.k')::DOUBLE AS k FROM events)
    SELECT event_type, count(*) AS n, count(CASE WHEN k BETWEEN 0 AND 100 THEN 1 END) AS readable, round(avg(CASE WHEN k BETWEEN 0 AND 100 THEN k / 100 END), 6) AS mean,
           round(avg(CASE WHEN k BETWEEN 0 AND 100 AND k > 0 THEN k / (k + 20) END), 6) AS share, round(avg(exp(-k / 50) / (exp(-k / 50) + exp(-1.0))), 6) AS p_yes FROM e GROUP BY event_type""")
def q39_json_prob(events):
    """Probabilities from JSON, shares rescaled to 1, and P(yes) from token log probabilities."""
    k = F.get_json_object("props", "$.k")
    p = answers.probability(F.concat(F.lit('{"probability": '), k, F.lit("}")))
    shares = answers.option_shares(F.concat(F.lit('{"a": '), k, F.lit(', "b": 20}')), ["a", "b"])
    logs = F.create_map(F.lit("Yes"), -k.cast("double") / 50, F.lit("no"), F.lit(-1.0))
    rows = events.select("event_type", p.alias("p"), F.when(k.cast("double") > 0, F.element_at(shares, "a")).alias("a"), answers.yes_probability(logs).alias("y"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("readable"), r6(F.avg("p")).alias("mean"), r6(F.avg("a")).alias("share"), r6(F.avg("y")).alias("p_yes"))


@query("events", sql="""
    WITH e AS (SELECT event_type, -(1 + event_id % 50) / 10.0 AS lp FROM events) SELECT event_type, count(*) AS n, round(sum(ln(1 - exp(lp))), 4) AS filled, round(avg(1 - exp(lp)), 6) AS mean_p FROM e GROUP BY event_type""")
def q40_logprob_fill(events):
    """The complement of a token's log probability."""
    c = answers.complement(-(1 + F.col("event_id") % 50) / 10.0)
    return events.select("event_type", c.alias("c")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c"), 4).alias("filled"), r6(F.avg(F.exp("c"))).alias("mean_p"))


@query("orders", sql="""
    SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN o_orderdate WHEN 1 THEN date_trunc('minute', o_orderdate) WHEN 2 THEN date_trunc('day', o_orderdate) WHEN 3 THEN o_orderdate WHEN 4 THEN date_trunc('day', o_orderdate) WHEN 5 THEN date_trunc('month', o_orderdate) END AS t,
           CASE WHEN o_orderkey % 3 < 2 THEN o_custkey % 12 END AS horizon FROM orders""")
def q41_dates_multi(orders):
    """Order dates written in six formats and read back, and the horizon in a task's name; what is neither is null."""
    at = lambda f: F.date_format("o_orderdate", f)
    forms = [at("yyyy-MM-dd HH:mm:ss"), at("yyyy-MM-dd HH:mm"), at("yyyy-MM-dd"), F.concat(at("yyyy-MM-dd"), F.lit("T"), at("HH:mm:ss"), F.lit("Z")), at("yyyyMMdd"), at("yyyyMM"), F.concat(at("yyyy"), F.lit("-02-30"))]
    text = F.expr("CASE " + " ".join(f"WHEN o_orderkey % 7 = {i} THEN f[{i}]" for i in range(7)) + " END")
    years = (F.col("o_custkey") % 12).cast("string")
    task = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("died_"), years, F.lit("_yr"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("x_"), years, F.lit("_yr_late"))).otherwise(F.concat(F.lit("plain_"), years))
    rows = orders.withColumn("f", F.array(*forms)).select("o_orderkey", text.alias("d"), task.alias("task"))
    return rows.select("o_orderkey", dates.parse_time(F.col("d")).alias("t"), dates.horizon_years(F.col("task")).alias("horizon"))


@query("events", sql="""
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) - 1 AS place, sec AS "time", event_type || '/' || event_id AS code, props AS value FROM (SELECT *, date_trunc('second', ts) AS sec FROM events) WHERE ts IS NOT NULL""")
def q64_xml_events(events):
    """Every user's events written as one XML text, newest first, and read back in order of time, then of the event."""
    escaped = F.replace(F.replace("props", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    entry = F.concat(F.lit('<entry timestamp="'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('"><event code="'), "event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit('">'), escaped, F.lit("</event></entry>"))
    listed = F.sort_array(F.collect_list(F.struct("ts", F.col("event_id"), entry.alias("x"))), False)  # one user's events
    texts = events.where("ts IS NOT NULL").groupBy("user_id").agg(F.concat(F.lit("<encounter>"), F.array_join(F.transform(listed, lambda z: z["x"]), ""), F.lit("</encounter>")).alias("x"))
    e = texts.select("user_id", F.posexplode(readers.events_of_xml(F.col("x"))).alias("doc_ord", "e"))
    read = e.select("user_id", "doc_ord", dates.parse_time(F.col("e.time")).alias("time"), F.col("e.code").alias("code"), F.col("e.value").alias("value"))
    w = Window.partitionBy("user_id").orderBy("time", F.split("code", "/")[1].cast("bigint"))
    return read.select("user_id", (F.row_number().over(w) - 1).cast("bigint").alias("place"), "time", "code", "value")
