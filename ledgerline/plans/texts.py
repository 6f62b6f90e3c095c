"""Rendering, line operations, retrieval, vectors, templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import arrays, text
from ledgerline.operators import joins, postings, timeline
from ledgerline.plans.register import query

r6 = lambda c: F.round(c, 6)
big = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")


@query("events", sql="""
    WITH l AS (SELECT user_id, ts, event_id, round(value * 100)::BIGINT AS c, '[' || strftime(ts, '%Y-%m-%d %H:%M') || '] | ' || event_type || ' (' || props || ') | VALUE: ' AS head FROM events)
    SELECT user_id, count(*) AS n, sha256(string_agg(head || CASE WHEN c < 0 THEN '-' ELSE '' END || (abs(c) // 100) || '.' || lpad((abs(c) % 100)::VARCHAR, 2, '0') || ' u', chr(10) ORDER BY ts, event_id)) AS digest FROM l GROUP BY user_id""")
def q34_render_timeline(events):
    """Every user's events as lines in order of time and id; values in whole hundredths."""
    cents = F.round(F.col("value") * 100, 0).cast("bigint")
    line = text.event_line(F.col("ts"), F.col("event_type"), F.col("props"), text.one_decimal(cents), F.lit("u"))
    t = timeline.ordered_text(events, ["user_id"], [F.col("ts"), F.col("event_id")], line, "timeline")
    return t.select("user_id", text.count_events(F.col("timeline")).alias("n"), F.sha2(F.col("timeline").cast("binary"), 256).alias("digest"))


@query("documents", sql=r"""
    WITH d AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT contains(l, 'th')), chr(10)) AS kept FROM documents)
    SELECT doc_id, len(string_split(kept, chr(10))) AS lines, CASE WHEN len(string_split(kept, chr(10))) <= 4 THEN kept ELSE chr(10) || CASE WHEN len(kept) > 79 THEN substr(kept, 1, 79) || '... [TRUNCATED]' ELSE kept END END AS head,
           sha256(array_to_string(list_transform(string_split(replace(kept, '.', '. ') || chr(10) || 'a | VALUE: 3', chr(10)), lambda l: regexp_replace(regexp_replace(l, '[ \t]+$', ''), '\s*\|\s*VALUE:.*$', '')), chr(10))) AS trimmed FROM d""")
def q35_line_ops(documents):
    """Lines with a marker dropped, line ends trimmed, VALUE parts stripped, text cut."""
    d = documents.select("doc_id", text.drop_lines(F.col("text"), "th").alias("kept"))
    spaced = F.concat(F.replace("kept", F.lit("."), F.lit(". ")), F.lit("\na | VALUE: 3"))
    trimmed = text.strip_value(text.trim_line_ends(spaced))
    return d.select("doc_id", big(F.size(F.split("kept", "\n"))).alias("lines"), text.truncate(F.col("kept"), 80).alias("head"), F.sha2(trimmed.cast("binary"), 256).alias("trimmed"))


BM25 = """tok AS (SELECT source, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    st AS (SELECT source, count(*) AS n, avg(len(w)) AS avg_dl FROM tok GROUP BY source)"""


def _score(posts: str) -> str:
    return f"""SELECT p.source, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score
        FROM {posts} p JOIN (SELECT source, term, count(*) AS df FROM {posts} GROUP BY ALL) f ON p.source = f.source AND p.term = f.term JOIN st ON st.source = p.source GROUP BY p.source, p.doc_id"""


@query("documents", folder=True, sql=f"""
    WITH {BM25}, posts AS (SELECT source, doc_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT source, doc_id, w, unnest(w) AS term FROM tok) WHERE term IN ('the', 'hend', 'tionat', 'und') GROUP BY ALL),
    sc AS ({_score("posts")}) SELECT source, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) WHERE rank <= 5""")
def q56_bm25(folder, documents):
    """Top five documents of each source for a fixed list of terms, from the table's posting index."""
    hits = postings.index_of(documents, f"{folder}/documents", "doc_id", "source", "text").search(["the", "hend", "tionat", "und"], 5)
    return hits.select(F.col("part").alias("source"), F.col("key").alias("doc_id"), r6("score").alias("score"), "rank")


@query("documents", folder=True, sql=f"""
    WITH {BM25}, p1 AS (SELECT source, doc_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT source, doc_id, w, unnest(w) AS term FROM tok) WHERE term IN ('hend', 'und') GROUP BY ALL),
    s1 AS ({_score("p1")}), h1 AS (SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s1) WHERE rank <= 3),
    c AS (SELECT source, term, count(*) AS c FROM (SELECT h1.source, unnest(w) AS term FROM h1 JOIN tok USING (source, doc_id)) WHERE len(term) >= 4 AND term NOT IN ('hend', 'und') GROUP BY ALL),
    t2 AS (SELECT source, term FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, term) AS r FROM c) WHERE r <= 3),
    p2 AS (SELECT x.source, x.doc_id, dl, x.term, count(*) AS tf FROM (SELECT source, doc_id, len(w) AS dl, unnest(w) AS term FROM tok) x SEMI JOIN t2 ON t2.source = x.source AND t2.term = x.term GROUP BY ALL),
    s2 AS ({_score("p2")}), h2 AS (SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s2) WHERE rank <= 3)
    SELECT source, doc_id, min(i)::BIGINT AS iteration FROM (SELECT *, 0 AS i FROM h1 UNION ALL SELECT *, 1 FROM h2) GROUP BY ALL""")
def q57_iter_retrieval(folder, documents):
    """Two rounds over the index of q56: the second searches the most frequent new words of the first round's hits."""
    index = postings.index_of(documents, f"{folder}/documents", "doc_id", "source", "text")
    return index.iterative_search(["hend", "und"], rounds=2, k=3, n_terms=3).select(F.col("part").alias("source"), F.col("key").alias("doc_id"), "iteration")


@query("embeddings", sql="""
    WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, unnest(range(1, len(embedding) + 1)) t(i) GROUP BY ALL),
    a AS (SELECT label, list(m ORDER BY i) AS m FROM c GROUP BY label),
    s AS (SELECT vec_id, e.label, a.label AS near, list_cosine_similarity(embedding::DOUBLE[], m) AS cos FROM embeddings e, a),
    h AS (SELECT vec_id, list_cosine_similarity(embedding[1:len(embedding) // 2]::DOUBLE[], embedding[len(embedding) // 2 + 1:]::DOUBLE[]) > 0.2 AS halves FROM embeddings)
    SELECT vec_id, any_value(s.label) AS label, arg_max(near, (round(cos, 9), -near)) AS nearest, round(max(cos), 6) AS cos, any_value(halves) AS halves FROM s JOIN h USING (vec_id) GROUP BY vec_id""")
def q58_cosine_join(embeddings):
    """Nearest label centroid of every vector, and whether its halves are alike."""
    cells = embeddings.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    cents = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("m"))  # one value a dimension
    half = F.floor(F.size("embedding") / 2).cast("int")
    halves = arrays.cosine(F.slice("embedding", F.lit(1), half), arrays.second_half(F.col("embedding"))) > 0.2
    found = joins.nearest(embeddings, "vec_id", "embedding", cents, "label", "m")
    return found.select("vec_id", "label", "nearest", r6("cos").alias("cos"), halves.alias("halves"))


@query("part", sql="""
    SELECT p_partkey, list_transform(range(9), lambda i: floor(i / 8.0 * (p_size - 1))::BIGINT) AS spaced, CASE WHEN p_size <= 20 THEN range(p_size) ELSE list_transform(range(1, 21), lambda i: round_even(i / 20.0 * (p_size - 1), 0)::BIGINT) END AS uniform,
           [p_size // 2]::BIGINT[] AS mid, list_filter(range(p_size), lambda i: i % 7 = 0) AS nth, CASE WHEN p_size <= 6 THEN range(p_size) ELSE list_transform(range(6), lambda i: i + (p_size - 6) // 2) END AS run6, list_filter(range(p_size), lambda i: i >= 3 AND i < 10) AS part_ FROM part""")
def q59_slice_indices(part):
    """Index generators over a depth."""
    d = F.col("p_size")
    return part.select("p_partkey", arrays.evenly_spaced(d, 9).alias("spaced"), arrays.uniform_tail(d, 20).alias("uniform"), arrays.centre(d).alias("mid"), arrays.every_nth(d, 7).alias("nth"), arrays.centre_run(d, 6).alias("run6"), arrays.index_range(d, 3, 10).alias("part_"))


@query("embeddings", sql="""
    WITH w AS (SELECT vec_id, list_transform(embedding, lambda v: (least(greatest(v::DOUBLE, -0.1), 0.15) - -0.1) / 0.25 * 255.0) AS x, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings)
    SELECT vec_id, round(list_min(x), 6) AS low, round(list_max(x), 6) AS high, list_sum(list_transform(x, lambda v: floor(round(v, 6))::BIGINT))::BIGINT AS cut,
           list_sum(list_transform(e, lambda v: floor((v - list_min(e)) / (list_max(e) - list_min(e)) * 255.0)::BIGINT))::BIGINT AS scaled FROM w""")
def q60_windowing(embeddings):
    """Clipping, scaling and per-array min-max in whole numbers."""
    x = arrays.window_values(F.col("embedding"), -0.1, 0.15)
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, v: s + v)
    cut = F.transform(x, lambda v: F.floor(F.round(v, 6)).cast("bigint"))
    return embeddings.select("vec_id", r6(F.array_min(x)).alias("low"), r6(F.array_max(x)).alias("high"), total(cut).alias("cut"), total(arrays.min_max_bytes(F.col("embedding"))).alias("scaled"))


@query("conversations", sql="""
    SELECT conv_id, turn, role, sha256('Q: [X] ' || CASE WHEN strpos('T [PATIENT_TIMELINE] and [PATIENT_TIMELINE]', '[PATIENT_TIMELINE]') > 0 THEN 'T ' || coalesce(text, '') || ' and [PATIENT_TIMELINE]' END) AS prompt FROM conversations""")
def q63_template(conversations):
    """A template whose placeholder is filled in its first place only."""
    t = text.replace_first(F.lit("T [PATIENT_TIMELINE] and [PATIENT_TIMELINE]"), "[PATIENT_TIMELINE]", F.coalesce("text", F.lit("")))
    return conversations.select("conv_id", "turn", "role", F.sha2(F.concat(F.lit("Q: [X] "), t).cast("binary"), 256).alias("prompt"))
