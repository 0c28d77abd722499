"""Queries of text, captions, transcripts, labels and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import geometry as G
from spanloom.functions import images as I
from spanloom.functions import text as X
from spanloom.functions import time as T
from spanloom.operators import captions, measures, tags, transcripts
from spanloom.plans.tables import EVENTS, events, read

#: What SQL calls the key, tokens and squeezed form of a text.
KEY_SQL = r"lower(regexp_replace({x}, '[^\p{{L}}\p{{M}}\p{{N}}_]+', '', 'g'))"
TOKENS_SQL = r"regexp_extract_all({x}, '[\p{{L}}\p{{M}}\p{{N}}_]+(?:[''’][\p{{L}}\p{{M}}\p{{N}}_]+)*')"
STRIP_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace({x}, '[（(\[【][^)\]）】]{{0,60}}[)\]）】]', ' ', 'g'), '^\s*[-–—]\s+', ''), '\s+', ' ', 'g'))"
NUMBERS_SQL = r"regexp_extract_all({x}, '[+-]?\d+(?:[.,:/-]\d+)*')"


def text_key(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", X.text_key(F.col("text")).alias("key"))


def number_tokens(spark: SparkSession, sf: str) -> DataFrame:
    found = X.number_tokens(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(found).cast("long").alias("n_numbers"), F.array_join(found, " ").alias("numbers"))


def strip_conventions(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", X.strip_conventions(F.col("text")).alias("line"))


def token_count(spark: SparkSession, sf: str) -> DataFrame:
    words = X.tokens(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.sha2(F.array_join(words, "|"), 256).alias("digest"))


def normal_form(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with letters and digits behind them that have another compatibility form."""
    return read(spark, sf, "conversations").select("conv_id", "turn", F.sha2(X.normalize(F.concat("text", F.lit(" \ufb01\uff21\uff11\u00b2 \u1e9e"))), 256).alias("digest"))


def script_share(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with some Korean behind them: its share of their letters, and that of a language without a script of its own."""
    rows = read(spark, sf, "documents")
    text = F.concat("text", F.repeat(F.lit(" 안녕하세요"), (F.col("doc_id") % 7 * 40).cast("int")))
    return rows.select("doc_id", X.script_share(text, F.lit("ko-KR")).alias("korean"), X.script_share(F.col("text"), F.col("lang")).alias("own"))


def clean_markup(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", F.sha2(X.clean_text(F.col("html")), 256).alias("digest"))


def clause_count(spark: SparkSession, sf: str) -> DataFrame:
    found = captions.clauses(F.col("text"))
    return read(spark, sf, "conversations").select("conv_id", "turn", F.size(found).cast("long").alias("n_clauses"))


def number_safety(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a turn has numbers that the turn before it, read in order, does not."""
    rows = read(spark, sf, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = rows.withColumn("__before", F.lag("text").over(order)).where(F.col("__before").isNotNull())
    return before.select("conv_id", "turn", X.adds_numbers(F.col("text"), F.col("__before")).alias("adds"), (F.size(X.number_tokens(F.col("text"))) > 0).alias("has"))


def _cues(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as caption tracks: a line every four seconds."""
    return read(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ordinal"), (F.col("turn") * 4_000_000).alias("start_us"), "text")


def caption_spans(spark: SparkSession, sf: str) -> DataFrame:
    return captions.with_ends(_cues(spark, sf), ["conv_id"]).select("conv_id", "ordinal", "start_us", "end_us")


def token_placement(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every line over its span: their number, and the first and last moment."""
    placed = captions.token_moments(captions.with_ends(_cues(spark, sf), ["conv_id"]), F.lit(False))
    return placed.groupBy("conv_id", "ordinal").agg(F.count("*").alias("n"), F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us"))


def route_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("k", F.col("event_id").alias("ordinal"), "start_us", F.floor("value").cast("long").alias("tokens"), "value", "kind")
    lines = rows.withColumns({"tokens_in_speech": F.when(F.col("kind").isin("view", "click"), F.col("tokens")).otherwise(0), "on_screen": F.when(F.col("value") >= 1, F.col("kind") == "purchase")})
    settings = captions.Attribution(neighbourhood_us=6 * 3600 * T.SECOND, screen_share=0.3)
    return captions.route(lines, ["k"], settings).select(F.col("ordinal").alias("event_id"), "decision")


def decision_counts(spark: SparkSession, sf: str) -> DataFrame:
    routed = route_window(spark, sf).join(events(spark, sf).select("event_id", "k"), "event_id")
    counted = routed.groupBy("k").agg(*(F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in ("audio", "text", "drop")))
    return counted.withColumn("verdict", captions.verdict(F.col("k") % 7 != 0, F.col("n_audio"), F.col("n_text")))


def best_account(spark: SparkSession, sf: str) -> DataFrame:
    """Of each user and kind, all events of the day that holds the greatest value."""
    rows = events(spark, sf).withColumn("day", F.floor(F.col("start_us") / (86400 * T.SECOND)))
    top = rows.withColumn("best", F.max("value").over(Window.partitionBy("k", "kind", "day")))
    return transcripts.best_account(top, ["k", "kind"], "best", "day").select("event_id", "k", "kind")


def clip_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each event's day that its span covers, in millionths."""
    day = 86400 * T.SECOND
    start = F.floor(F.col("start_us") / day) * day
    share = transcripts.coverage(F.col("start_us"), F.col("end_us"), start, start + day)
    return events(spark, sf).select("event_id", F.floor(share * 1_000_000).alias("millionths"))


def conversation_digest(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations")
    return transcripts.digest(rows, ["conv_id"], ["turn", "role"], F.concat(F.col("turn").cast("string"), F.lit(":"), X.text_key(F.col("text"))))


def conversation_text(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.joined_text(read(spark, sf, "conversations"), ["conv_id"], ["turn", "role"], "text")


def label_two_bar(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's day of events as scored labels, ranked by score: the names that clear both bars.

    Of the labels one is spoken, one abstract, one another's name, and one has a remark and a second name; those
    that are discarded still set the bar.
    """
    rows = events(spark, sf).withColumn("day", F.floor(F.col("start_us") / (86400 * T.SECOND)))
    label = F.create_map(*(F.lit(x) for x in ("view", "Speech", "error", "Animal", "click", "Siren", "purchase", "Chirp (small), tweet", "signup", "Hubbub,  babble")))[F.col("kind")]
    ranked = F.sort_array(F.collect_list(F.struct(F.col("value").alias("confidence"), F.col("event_id"), label.alias("label"))), asc=False)
    listed = rows.groupBy("k", "day").agg(ranked.alias("tags"))
    return listed.select("k", "day", F.array_join(tags.kept(F.col("tags"), 5.0, 0.4), " ").alias("names"))


def top_labels(spark: SparkSession, sf: str) -> DataFrame:
    return measures.strongest(events(spark, sf), ["k"], "value", "event_id", 4, 20.0).select("k", "rank", "event_id", "kind")


def median_height(spark: SparkSession, sf: str) -> DataFrame:
    return measures.middle(events(spark, sf), ["k", "kind"], "value")


def first_language(spark: SparkSession, sf: str) -> DataFrame:
    """Of each source the first document's language that isn't English, and the one language where there is one."""
    return measures.languages(read(spark, sf, "documents"), ["source"], "lang", "doc_id")


def priced_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Cost of each user's calls in millionths, cached tokens at their own rate; null where nothing is priced."""
    rows = events(spark, sf).select("k", F.floor(F.col("value") * 100).cast("long").alias("read"), (F.col("event_id") % 97 * 10).alias("cached"), "kind")
    price = F.when(F.col("kind") == "purchase", measures.cost(F.col("read"), F.col("cached"), 3, 1))
    return measures.token_totals(rows, ["k"], price)


def mean_hash(spark: SparkSession, sf: str) -> DataFrame:
    bits = I.mean_bits(F.col("embedding").cast("array<double>"))
    return read(spark, sf, "embeddings").select("vec_id", F.array_join(bits.cast("array<string>"), "").alias("bits"))


def difference_hash(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.col("embedding").cast("array<double>")
    along, down = I.difference_bits(cells, 8, 1), I.difference_bits(cells, 8, 8)
    return read(spark, sf, "embeddings").select("vec_id", F.array_join(along.cast("array<string>"), "").alias("along"), F.array_join(down.cast("array<string>"), "").alias("down"))


def hamming_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    """Differing bits of each image's mean hash and that of the image before it of its label."""
    words = I.words(I.mean_bits(F.col("embedding").cast("array<double>")))
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = read(spark, sf, "embeddings").select("vec_id", "label", words.alias("w")).withColumn("__b", F.lag("w").over(order))
    return rows.where(F.col("__b").isNotNull()).select("vec_id", I.hamming(F.col("w"), F.col("__b")).cast("long").alias("distance"))


def signature_change(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("c")).withColumn("__b", F.lag("c").over(order))
    return rows.where(F.col("__b").isNotNull()).select("vec_id", (I.differing_share(F.col("c"), F.col("__b"), 0.1) >= 0.5).alias("changed"))


def box_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes from the first eight cells of each image: their band, size, and overlap with the next box of the label."""
    e = lambda i: F.abs(F.element_at(F.col("embedding").cast("array<double>"), i))
    rows = read(spark, sf, "embeddings").select("vec_id", "label", e(1).alias("left"), e(2).alias("top"), (e(1) + e(3) + 0.01).alias("right"), (e(2) + e(4) + 0.01).alias("bottom"))
    order = Window.partitionBy("label").orderBy("vec_id")
    joined = rows.withColumns({f"n_{s}": F.lead(s).over(order) for s in G.SIDES})
    here, there = G.box(""), G.box("n_")
    return joined.select("vec_id", G.position(here).alias("position"), G.size(here[3] - here[1]).alias("size"), F.when(F.col("n_left").isNotNull(), G.spatial_overlap(here, there) >= 0.45).alias("overlaps"))


def sequence_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of each benchmark text and that of the next number; matching blocks have no SQL."""
    rows = read(spark, sf, "benchmark")
    rows = rows.join(rows.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("after")), "item_id")
    return rows.select("item_id", F.round(X.ratio(F.col("text"), F.col("after"), False), 6).alias("ratio"))


QUERIES = {f.__name__: f for f in (text_key, number_tokens, strip_conventions, token_count, normal_form, script_share, clean_markup, clause_count, number_safety, caption_spans, token_placement, route_window, decision_counts, best_account, clip_coverage, conversation_digest, conversation_text, label_two_bar, top_labels, median_height, first_language, priced_cost, mean_hash, difference_hash, hamming_adjacent, signature_change, box_bands, sequence_ratio)}

CUES = """c AS (SELECT conv_id, turn AS ordinal, turn * 4000000 AS start_us, text FROM conversations),
cs AS (SELECT *, greatest(coalesce(lead(start_us) OVER (PARTITION BY conv_id ORDER BY start_us, ordinal), start_us + greatest(1000000, length(text) * 60000)), start_us + 200000) AS end_us FROM c)"""
ROUTE = f"""{EVENTS}, l AS (SELECT event_id, k, start_us, CAST(floor(value) AS BIGINT) AS tok, CASE WHEN kind IN ('view', 'click') THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS ins,
  CASE WHEN value >= 1 THEN CAST(kind = 'purchase' AS INT) END AS seen FROM ev),
w AS (SELECT *, count(*) OVER r AS n, sum(tok) OVER r AS rt, sum(ins) OVER r AS ri, count(seen) OVER r AS rg, sum(seen) OVER r AS ry,
  sum(tok) OVER b AS bt, sum(ins) OVER b AS bi, count(seen) OVER b AS bg, sum(seen) OVER b AS byes FROM l
  WINDOW r AS (PARTITION BY k ORDER BY start_us RANGE BETWEEN 21600000000 PRECEDING AND 21600000000 FOLLOWING), b AS (PARTITION BY k ORDER BY start_us, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
p AS (SELECT event_id, k, CASE WHEN n < 3 THEN bt ELSE rt END AS t, CASE WHEN n < 3 THEN bi ELSE ri END AS i, CASE WHEN n < 3 THEN bg ELSE rg END AS g, CASE WHEN n < 3 THEN byes ELSE ry END AS y FROM w),
d AS (SELECT event_id, k, CASE WHEN (CASE WHEN t > 0 THEN i::DOUBLE / t ELSE 0 END) >= 0.6 THEN 'audio' WHEN (CASE WHEN g > 0 THEN y::DOUBLE / g ELSE 0 END) >= 0.3 THEN 'text' ELSE 'drop' END AS decision FROM p)"""
BOXES = """b AS (SELECT vec_id, label, abs(embedding[1]::DOUBLE) AS l, abs(embedding[2]::DOUBLE) AS t, abs(embedding[1]::DOUBLE) + abs(embedding[3]::DOUBLE) + 0.01::DOUBLE AS r, abs(embedding[2]::DOUBLE) + abs(embedding[4]::DOUBLE) + 0.01::DOUBLE AS m FROM embeddings),
n AS (SELECT *, lead(l) OVER w AS l2, lead(t) OVER w AS t2, lead(r) OVER w AS r2, lead(m) OVER w AS m2 FROM b WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
h AS (SELECT *, greatest(m - t, 0.001::DOUBLE) AS h1, greatest(m2 - t2, 0.001::DOUBLE) AS h2,
  greatest(0, least(r, r2) - greatest(l, l2)) / greatest(least(r - l, r2 - l2), 0.001::DOUBLE) AS ox, greatest(0, least(m, m2) - greatest(t, t2)) / greatest(least(m - t, m2 - t2), 0.001::DOUBLE) AS oy FROM n)"""
BITS = "b AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), h AS (SELECT *, list_transform(e, lambda x: CAST(x > list_sum(e) / 64 AS INT)) AS bits FROM b)"

ORACLES = {
    "text_key": f"SELECT doc_id, {KEY_SQL.format(x='text')} AS key FROM documents",
    "number_tokens": f"SELECT doc_id, len({NUMBERS_SQL.format(x='text')}) AS n_numbers, array_to_string({NUMBERS_SQL.format(x='text')}, ' ') AS numbers FROM documents",
    "strip_conventions": f"SELECT doc_id, {STRIP_SQL.format(x='text')} AS line FROM documents",
    "token_count": f"SELECT doc_id, len({TOKENS_SQL.format(x='text')}) AS n_tokens, sha256(array_to_string({TOKENS_SQL.format(x='text')}, '|')) AS digest FROM documents",
    "normal_form": f"SELECT conv_id, turn, sha256(replace({KEY_SQL.format(x='text')}, 'ß', 'ss') || 'fia12ss') AS digest FROM conversations",
    "script_share": r"""WITH t AS (SELECT doc_id, text || repeat(' 안녕하세요', doc_id % 7 * 40) AS text FROM documents)
SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\p{L}가-힣]', '', 'g')) > 0 THEN length(regexp_replace(text, '[^가-힣]', '', 'g'))::DOUBLE / length(regexp_replace(text, '[^\p{L}가-힣]', '', 'g')) ELSE 0.0 END AS korean, CAST(NULL AS DOUBLE) AS own FROM t""",
    "clean_markup": r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), ' ', ' '), '<[^>]{0,40}>', '', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages""",
    "clause_count": rf"""WITH p AS (SELECT conv_id, turn, list_concat([text], regexp_split_to_array(text, '[,\.!?·]\s+|\s{{2,}}')) AS a FROM conversations)
SELECT conv_id, turn, len(list_filter(a, lambda x: length({KEY_SQL.format(x='x')}) >= 3)) AS n_clauses FROM p""",
    "number_safety": rf"""WITH RECURSIVE t AS (SELECT conv_id, turn, {NUMBERS_SQL.format(x='text')} AS c, {NUMBERS_SQL.format(x='b')} AS r FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS b FROM conversations) WHERE b IS NOT NULL),
s AS (SELECT conv_id, turn, c, r, 0::BIGINT AS i, true AS ok FROM t
  UNION ALL SELECT conv_id, turn, c, CASE WHEN list_position(r, c[i + 1]) > 0 THEN r[list_position(r, c[i + 1]) + 1:] ELSE r END, i + 1, ok AND coalesce(list_position(r, c[i + 1]), 0) > 0 FROM s WHERE i < len(c))
SELECT conv_id, turn, NOT ok AS adds, len(c) > 0 AS has FROM s WHERE i = len(c)""",
    "caption_spans": f"WITH {CUES} SELECT conv_id, ordinal, start_us, end_us FROM cs",
    "token_placement": f"""WITH {CUES}, n AS (SELECT *, len({TOKENS_SQL.format(x=STRIP_SQL.format(x='text'))}) AS n FROM cs)
SELECT conv_id, ordinal, n, start_us + (end_us - start_us) // (2 * n) AS first_us, start_us + (end_us - start_us) * (2 * n - 1) // (2 * n) AS last_us FROM n WHERE n > 0""",
    "route_window": f"WITH {ROUTE} SELECT event_id, decision FROM d",
    "decision_counts": f"""WITH {ROUTE}, c AS (SELECT k, count(*) FILTER (decision = 'audio') AS n_audio, count(*) FILTER (decision = 'text') AS n_text, count(*) FILTER (decision = 'drop') AS n_drop FROM d GROUP BY k)
SELECT *, CASE WHEN k % 7 = 0 THEN 'rejected_language' WHEN n_audio > 0 AND n_text > 0 THEN 'mixed' WHEN n_audio > 0 THEN 'speech_transcript' WHEN n_text > 0 THEN 'hardsub_copy' ELSE 'rejected_unaligned' END AS verdict FROM c""",
    "best_account": f"""WITH {EVENTS}, d AS (SELECT *, start_us // 86400000000 AS day FROM ev), b AS (SELECT *, max(value) OVER (PARTITION BY k, kind, day) AS best FROM d),
r AS (SELECT *, rank() OVER (PARTITION BY k, kind ORDER BY best DESC, day DESC) AS n FROM b) SELECT event_id, k, kind FROM r WHERE n = 1""",
    "clip_coverage": f"WITH {EVENTS} SELECT event_id, CAST(floor(greatest(0, least(end_us, start_us // 86400000000 * 86400000000 + 86400000000) - start_us)::DOUBLE / 86400000000 * 1000000) AS BIGINT) AS millionths FROM ev",
    "conversation_digest": f"SELECT conv_id, sha256(string_agg(turn || ':' || {KEY_SQL.format(x='text')}, '|' ORDER BY turn, role)) AS digest FROM conversations GROUP BY conv_id",
    "conversation_text": "SELECT conv_id, string_agg(text, ' ' ORDER BY turn, role) AS text FROM conversations GROUP BY conv_id",
    "label_two_bar": f"""WITH {EVENTS}, d AS (SELECT *, start_us // 86400000000 AS day FROM ev), m AS (SELECT *, max(value) OVER (PARTITION BY k, day) * 0.4::DOUBLE AS floor FROM d),
p AS (SELECT k, day, CASE kind WHEN 'click' THEN 'alarm' WHEN 'purchase' THEN 'birds' ELSE 'crowd' END AS kind, max(value) AS v, arg_max(event_id, (value, event_id)) AS e FROM m WHERE value >= 5 AND value >= floor AND kind IN ('click', 'purchase', 'signup') GROUP BY k, day, kind),
n AS (SELECT k, day, string_agg(kind, ' ' ORDER BY v DESC, e DESC) AS names FROM p GROUP BY k, day) SELECT DISTINCT d.k, d.day, coalesce(n.names, '') AS names FROM d LEFT JOIN n ON d.k = n.k AND d.day = n.day""",
    "top_labels": f"WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY value DESC, event_id) AS rank FROM ev) SELECT k, rank, event_id, kind FROM r WHERE rank <= 4 AND value >= 20",
    "median_height": f"WITH {EVENTS} SELECT k, kind, median(value) AS median_value FROM ev GROUP BY k, kind",
    "first_language": "SELECT source, arg_min(lang, doc_id) FILTER (lang <> 'en') AS first_other, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS only_lang, count(DISTINCT lang) AS n_langs FROM documents GROUP BY source",
    "priced_cost": f"""WITH {EVENTS}, c AS (SELECT k, kind, CAST(floor(value * 100) AS BIGINT) AS read, event_id % 97 * 10 AS cached FROM ev)
SELECT k, CAST(sum(CASE WHEN kind = 'purchase' THEN (read - least(cached, read)) * 3 + least(cached, read) END) AS BIGINT) AS cost, CAST(sum(read) AS BIGINT) AS tokens FROM c GROUP BY k""",
    "mean_hash": f"WITH {BITS} SELECT vec_id, array_to_string(bits, '') AS bits FROM h",
    "difference_hash": f"""WITH {BITS} SELECT vec_id, array_to_string(list_transform(list_filter(range(1, 65), lambda i: (i - 1) % 8 < 7), lambda i: CAST(e[i] > e[i + 1] AS INT)), '') AS along,
array_to_string(list_transform(range(1, 57), lambda i: CAST(e[i] > e[i + 8] AS INT)), '') AS down FROM b""",
    "hamming_adjacent": f"""WITH {BITS}, p AS (SELECT vec_id, bits, lag(bits) OVER (PARTITION BY label ORDER BY vec_id) AS was FROM h) SELECT vec_id, len(list_filter(range(1, 65), lambda i: bits[i] <> was[i])) AS distance FROM p WHERE was IS NOT NULL""",
    "signature_change": f"""WITH {BITS}, p AS (SELECT vec_id, e, lag(e) OVER (PARTITION BY label ORDER BY vec_id) AS was FROM b) SELECT vec_id, len(list_filter(range(1, 65), lambda i: abs(e[i] - was[i]) >= 0.1::DOUBLE)) / 64.0 >= 0.5 AS changed FROM p WHERE was IS NOT NULL""",
    "box_bands": f"""WITH {BOXES} SELECT vec_id, concat(CASE WHEN (t + m) / 2 < 0.33::DOUBLE THEN 'top' WHEN (t + m) / 2 < 0.66::DOUBLE THEN 'middle' ELSE 'bottom' END, ' ', CASE WHEN (l + r) / 2 < 0.33::DOUBLE THEN 'left' WHEN (l + r) / 2 < 0.66::DOUBLE THEN 'center' ELSE 'right' END) AS position,
CASE WHEN m - t < 0.04::DOUBLE THEN 'small' WHEN m - t < 0.08::DOUBLE THEN 'medium' ELSE 'large' END AS size,
CASE WHEN l2 IS NULL THEN NULL WHEN greatest(h1, h2) / least(h1, h2) > 2.5::DOUBLE THEN false ELSE least(ox, oy) >= 0.45::DOUBLE END AS overlaps FROM h""",
}
