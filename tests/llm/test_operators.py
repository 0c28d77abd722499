"""Each text operator against a plain version, and over odd rows: nulls, empties, long texts, ties, repeats, no rows."""

import hashlib
import math
import random
import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bpe, components, language, linkgraph, neardup, neighbours, packing, quality, sharding
from spanloom.llm.queries import TREE, tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "", 0),
    (3, " \t\n", "en", "s", 3),
    (4, "word " * 30_000, "en", "s", 150_000),
    (5, "x" * 60_000, "en", None, 60_000),
    (6, "same text of a row that is there twice", "en", "s", 1),
    (6, "same text of a row that is there twice", "en", "s", 1),
    (7, "same text of a row that is there twice", "fr", "t", 1),
    (None, "a row without its id", "en", "s", 1),
    (8, "Ünïcödé 日本語 \U0001f389 é <|endoftext|> tail", "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("__text2", F.lit("more")).withColumn("kept", F.lit(1)).withColumn("language", F.lit("z"))


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- quality


def test_quality_counts():
    t = quality.Text("a b c d\na b c d\n\nx# $")
    assert (len(t.words), t.word_chars, t.symbols, t.dup_lines, t.repeat_words) == (10, 11, 2, 1, 8)
    assert quality.Text("a a a a").repeat_words == 4


def test_quality_keeps_the_clean_and_drops_the_bad(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = quality.profile(docs, quality.plan(docs)).join(labels, "doc_id").toPandas()
    assert found[(found.quality == 0)].kept.sum() == 0
    assert found[(found.quality == 1) & ~found.base_failed].kept.all()


def test_quality_verdict_does_not_depend_on_order(docs):
    a = {r.doc_id: r.kept for r in quality.profile(docs, quality.RULES).collect()}
    b = {r.doc_id: r.kept for r in quality.profile(docs, quality.RULES[::-1]).collect()}
    assert a == b == {r.doc_id: r.doc_id in {k.doc_id for k in quality.judge(docs, quality.RULES).collect()} for r in docs.collect()}


def test_quality_orders_by_rejections_per_cost():
    fast, slow = quality.Rule("fast", lambda t: True), quality.Rule("slow", lambda t: sum(range(20_000)) > 0)
    assert [m.rule.name for m in quality.ordered(["x"] * 30, (slow, fast))] == ["fast", "slow"]


def test_quality_order_counts_what_is_alive_and_what_is_worked_out():
    wait = lambda t: sum(range(30_000)) > 0
    first = quality.Rule("first", lambda t: "a" in t.text)
    # rejects most of all, but of what the first leaves nothing
    shadow = quality.Rule("shadow", lambda t: wait(t) and "a" in t.text and len(t.text) < 9)
    other = quality.Rule("other", lambda t: wait(t) and wait(t) and "b" in t.text)
    found = quality.ordered(["a"] * 20 + ["b"] * 5 + ["c"] * 5, (shadow, other, first))
    assert [m.rule.name for m in found] == ["first", "other", "shadow"] and [round(m.rejected, 2) for m in found] == [0.67, 0.5, 0.0]
    # once words are split, a second rule over them costs less than one over something new
    text = quality.Text("one two three " * 3000)
    apart = quality.measure([text] * 5, quality.RULES[0]).seconds
    assert len(text.words) == 9000 and quality.measure([text] * 5, quality.RULES[0]).seconds < apart / 5


def test_quality_plan_is_one_for_any_order_of_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(quality, "ordered", lambda texts, rules: [quality.Measured(quality.Rule(str(x), bool), 1.0, 0.0) for x in texts])
    a = quality.plan(docs.orderBy("doc_id"), sample_rows=50)
    b = quality.plan(docs.orderBy(F.desc("text")).repartition(5), sample_rows=50)
    assert [r.name for r in a] == [r.name for r in b] and len(a) == 50


@pytest.mark.parametrize("text,rule", [("- one point of it\n" * 60, "bullets"), ("and so it goes on ...\n" * 20, "ellipses"), ("12 the 3.4 and 77 of 8-9 " * 20, "few_alphabetic"), ("zorb qux flim " * 20, "no_stop_words"), ("of course he and she " + "very well " * 30, "one_pair")])
def test_quality_rules(text, rule):
    by_name = {r.name: r for r in quality.RULES}
    assert by_name[rule].rejects(quality.Text(text))
    assert not by_name[rule].rejects(quality.Text("The house at the end of the road was sold in May to a family with two dogs."))


def test_quality_of_odd_rows(odd, none):
    rows = {r.doc_id: r for r in quality.profile(odd, quality.plan(odd)).collect()}
    assert rows[1].n_words == 0 and rows[1].base_failed and not rows[1].kept and rows[4].n_words == 30_000
    assert quality.profile(none, quality.plan(none)).count() == 0
    assert quality.judge(odd, quality.RULES).columns == odd.columns


# ---- language


def test_language_of_held_out_rows(spark, docs):
    profiles = language.fit(docs.where("doc_id % 2 = 0"), "text", "lang")
    held = docs.where("doc_id % 2 = 1").withColumn("none", F.lit(None).cast("string"))
    found = language.identify(held, declared=None, host=None, profiles=profiles).select("lang", "language").collect()
    assert sum(r.lang == r.language for r in found) >= 0.97 * len(found)


def test_a_rare_declared_language_has_a_profile(spark):
    body = F.when(F.col("id") == 77, "der Hund und die Katze").when(F.col("id") % 100 == 0, F.concat(F.lit("the dog and the cat "), "id")).otherwise(F.concat(F.lit("nothing is declared "), "id"))
    declared = F.when(F.col("id") == 77, "DE").when(F.col("id") % 100 == 0, "en")
    same = spark.range(30_000).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("le chien et le chat").alias("text"), F.lit("fr").alias("lang"), F.lit("c.x.org").alias("source"))
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), body.alias("text"), declared.alias("lang"), F.lit("a.x.org").alias("source")).unionByName(same)
    drawn = {}
    for r in language._drawn_by_language(df.where("lang is not null").select(F.col("text").alias("t"), F.lower("lang").alias("l")), language.Settings()).collect():
        drawn.setdefault(r.l, []).append(r.t)
    assert {k: len(v) for k, v in drawn.items()} == {"de": 1, "en": 300, "fr": 1}
    profiles = language.fit(df, "text", "lang")
    found = {r.doc_id: r.language for r in language.identify(df.where("doc_id in (-1, 77, 100)").distinct(), host=None, profiles=profiles).collect()}
    assert profiles.languages == ("de", "en", "fr", "und") and found == {-1: "fr", 77: "de", 100: "en"}


def test_other_evidence_decides_an_empty_text(spark):
    rows = [(i, "the cat and the dog", "en", "a.x.org") for i in range(30)] + [(i, "le chat et le chien", "fr", "b.x.org") for i in range(30, 60)]
    rows += [(100, "", None, "b.x.org"), (101, "", "en", None), (102, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in language.identify(df).collect()}
    assert found[100].language == "fr" and found[101].language == "en" and found[102].posterior < 0.6


def plain_fusion(rows, profiles, declared, suffix, host, settings=language.Settings()):
    """(text, declared, suffix, host) rows to (language, posterior), in plain loops."""
    names, known = profiles.languages, profiles.languages[:-1]
    lls, own = [], []
    for text, *_, h in rows:
        data = (" " + (text or "").lower() + " ").encode()
        ll = [0.0] * len(names)
        if (text or "").strip():
            for i in range(len(data) - 2):
                slot = ((data[i] * 65536 + data[i + 1] * 256 + data[i + 2]) * 2654435761 % 2**32) >> 16
                for n in range(len(names)):
                    ll[n] += float(profiles.weights[slot, n])
            ll = [x * settings.temper for x in ll]
        ll = [x - max(ll) for x in ll]
        lls.append(ll)
        own.append(ll.index(0.0) if host and h is not None and sum(x > -2 for x in ll) == 1 else None)
    out = []
    for i, (_, d, s, h) in enumerate(rows):
        counts = lambda among: [sum(own[j] == n for j in range(len(rows)) if j != i and among(rows[j][3])) for n in range(len(names))]  # noqa: B023, E731
        every = counts(lambda x: x is not None)
        prior = [(c + 1) / (sum(every) + len(names)) for c in every]
        if host and h is not None:
            for same in (lambda x: x is not None and x.split(".")[-2:] == h.split(".")[-2:], lambda x: x == h):  # noqa: B023
                level = counts(same)
                prior = [(c + settings.smoothing * p) / (sum(level) + settings.smoothing) for c, p in zip(level, prior, strict=True)]
        logs = [x + math.log(p) for x, p in zip(lls[i], prior, strict=True)]
        for used, value, right in ((declared, d, settings.declared_right), (suffix, s, settings.suffix_right)):
            if used and value is not None and value.lower() in known:
                logs = [x + math.log(1 / len(known) if n == "und" else right if n == value.lower() else max((1 - right) / max(len(known) - 1, 1), 1e-9)) for x, n in zip(logs, names, strict=True)]
        top = max(logs)
        out.append((names[logs.index(top)], 1 / sum(math.exp(x - top) for x in logs)))
    return out


def test_language_equals_plain_fusion(spark):
    rng = random.Random(4)
    some = {"en": "the cat and the dog saw that there was nothing", "fr": "le chat et le chien ont vu que rien", "de": "der Hund und die Katze sahen dass nichts da war"}
    rows = []
    for i in range(90):
        lang = rng.choice(list(some))
        words = some[lang].split()
        text = rng.choice([" ".join(rng.choices(words, k=rng.randrange(1, 12))), " ".join(rng.choices(words, k=8)), "", None, "ζωή και φως στον κόσμο"])
        rows.append((i, text, rng.choice([lang, None, "xx", "EN"]), rng.choice(["a.x.org", "b.x.org", "c.y.org", "d.z.org", None])))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("__ll", F.lit(1)).withColumn("posterior", F.lit("x"))
    profiles = language.fit(df, "text", "lang")
    want = plain_fusion([(t, d, None, h) for _, t, d, h in rows], profiles, True, False, True)
    found = {r.doc_id: r for r in language.identify(df, profiles=profiles).collect()}
    for (i, *_), (lang, p) in zip(rows, want, strict=True):
        assert found[i].language == lang and math.isclose(found[i].posterior, p, rel_tol=1e-6) and found[i].kept == (p >= 0.6 and lang != "und")


def test_language_pages_equals_plain_fusion(spark):
    from spanloom.llm import queries

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    parts = language.page_evidence(pages)
    profiles = language.fit(parts, "__plain", "__declared")
    rows = parts.orderBy("page_id").collect()
    want = plain_fusion([(r["__plain"], r["__declared"], r["__suffix"], r["__address_host"]) for r in rows], profiles, True, True, True)
    found = {r.page_id: r for r in queries.language_pages(spark, SF).collect()}
    assert len(found) == len(rows)
    for r, (lang, p) in zip(rows, want, strict=True):
        assert found[r.page_id].language == lang and math.isclose(found[r.page_id].posterior, p, abs_tol=1e-5)


def test_a_language_without_a_profile_is_unknown(spark, docs):
    profiles = language.fit(docs, "text", "lang")
    other = ["Мой дядя самых честных правил, когда не в шутку занемог, он уважать себя заставил", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である"]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(other)], "doc_id long, text string, lang string, source string")
    found = language.identify(df, profiles=profiles).collect()
    assert [r.language for r in found] == ["und"] * 3 and not any(r.kept for r in found)


def test_few_labelled_rows_fit_and_none_reject_nothing(spark):
    body = F.when(F.col("id") < 5, "the dog and the cat and the house").when(F.col("id") < 10, "der Hund und die Katze und das Haus").when(F.col("id") % 2 == 0, "a cat and the dog").otherwise("die Katze und der Hund")
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), body.alias("text"), F.when(F.col("id") < 5, "en").when(F.col("id") < 10, "de").alias("lang"), F.lit("h.org").alias("source"))
    found = {tuple(r) for r in language.identify(df).where("doc_id >= 10").select(F.col("doc_id") % 2, "language", "kept").distinct().collect()}
    assert found == {(0, "en", True), (1, "de", True)}
    bare = language.identify(df.withColumn("lang", F.lit(None).cast("string"))).select("language", "posterior", "kept").distinct().collect()
    assert [tuple(r) for r in bare] == [("und", 0.0, True)]


def test_page_evidence(spark):
    rows = [(1, "https://www.Site.example.net/de/x", "<html LANG='FR'><script>x</script><p>bonjour"), (2, None, None), (3, "https://a.fr", "<p>")]
    found = {r.page_id: r for r in language.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (found[1]["__declared"], found[1]["__suffix"], found[1]["__address_host"]) == ("fr", "de", "www.site.example.net")
    assert found[2]["__declared"] is None and found[3]["__suffix"] == "fr" and "x" not in found[1]["__plain"]


def test_language_of_odd_rows(odd, none, docs):
    assert language.identify(odd, keep=["doc_id", "lang", "source"]).count() == len(ODD)
    assert language.keep_identified(odd, write_to="lang").columns == odd.columns
    assert language.keep_identified(none).count() == 0


# ---- near duplicates


def plain_components(rows):
    """(doc_id, text) to {doc_id: (n, component)} by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(8, 90))] for _ in range(6)]
    rows = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(900)}"
        rows.append((i * 7 % 151, " ".join(words).upper() if i % 9 == 0 else " ".join(words)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "One\ttwo"), (904, " ")]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == plain_components(rows)


def test_rows_that_share_an_id_keep_their_own_links(spark):
    rng = random.Random(9)
    words = lambda: [f"w{rng.randrange(10_000)}" for _ in range(60)]
    near = lambda w: " ".join([*w[:59], "other"])
    a, b, c, d = words(), words(), words(), words()
    rows = [(5, " ".join(a)), (5, " ".join(b)), (2, near(a)), (3, near(b)), (1, " ".join(c)), (1, " ".join(d)), (12, near(c)), (13, near(d)), (1, " ".join(d)), (20, near(a)), (20, near(a))]
    for kind in ("long", "string"):
        df = spark.createDataFrame([(i if kind == "long" else f"{i:03d}", t, n) for n, (i, t) in enumerate(rows)], f"doc_id {kind}, text string, row int")
        found = {(int(r.doc_id), r.n_shingles, int(r.component_id)) for r in neardup.dedupe(df).collect()}
        assert found == {(5, 56, 2), (5, 56, 3), (2, 56, 2), (3, 56, 3), (1, 56, 1), (12, 56, 1), (13, 56, 1), (20, 56, 2)}
        kept = sorted((int(r.doc_id), r.text) for r in neardup.keep_one(df).collect())
        assert kept == sorted([(2, near(a)), (3, near(b)), (1, " ".join(c)), (1, " ".join(d))])


def test_a_bucket_of_many_unlinked_texts_is_tried_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "PIVOT_PAIRS", 10)
    # one band for all texts, so that they meet in one bucket
    monkeypatch.setattr(neardup, "signatures", lambda *a, real=neardup.signatures: real(*a).withColumn("bands", F.when(F.col("bands").isNotNull(), F.array(F.lit(1).cast("long")))))
    rng = random.Random(6)
    rows = []
    for i in range(120):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([30, 40]))]
        rows.append((2 * i, " ".join(base)))
        rows.append((2 * i + 1, " ".join([*base[:-1], "x"] if i % 3 else [f"v{rng.randrange(300)}" for _ in range(40)])))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == plain_components(rows)


def test_sets_on_both_sides_of_the_large_ones(spark):
    rng = random.Random(2)
    rows = []
    for i, (n, m) in enumerate([(900, 1100), (1010, 1040), (800, 1300), (1000, 1020), (950, 1250)]):
        long = [f"t{i}w{rng.randrange(100_000)}" for _ in range(m)]
        rows += [(2 * i, " ".join(long)), (2 * i + 1, " ".join(long[:n]))]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_components(rows)
    assert found == want and {c for _, c in want.values()} == {0, 2, 4, 5, 6, 8}


def test_near_duplicates_of_odd_rows(odd, none):
    found = {(r.doc_id): r for r in neardup.dedupe(odd).collect()}
    assert found[7].component_id == 6 and not found[7].kept and found[None].component_id is None and found[None].kept
    assert neardup.dedupe(none).count() == 0
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "8", "None"]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_sketch_limit_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    for n in (20, 150, 800, 3000):
        common = math.ceil(2 * n * 0.75 / 1.75)
        for _ in range(20):
            x = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
            bins = neardup.SMALL_BINS if n < neardup.LARGE else neardup.LARGE_BINS
            a, b = neardup.odd_sketch(np.sort(x[:n]), bins), neardup.odd_sketch(np.sort(np.concatenate([x[:common], x[n:]])), bins)
            apart = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
            filled = bins * (1 - math.exp(-(2 * n * 4 / 7) / bins))
            assert apart <= 512 * (1 - math.exp(-0.5 * filled * 2 / 1024)) + 60


# ---- byte-level BPE


def test_bpe_equals_the_library(odd, docs):
    whole = bpe.loaded(tokenizer("byte_bpe_50k.json"))
    for frame in (odd, docs):
        texts = sorted((r.text or "") for r in frame.collect())
        want = sorted((len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(whole.decode(i, skip_special_tokens=False).encode()).hexdigest()) for i in (whole.encode(t, add_special_tokens=False).ids for t in texts))
        found = bpe.encode_documents(frame, tokenizer("byte_bpe_50k.json"), digests=True).collect()
        assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == want


def test_bpe_of_random_strings():
    path = tokenizer("byte_bpe_50k.json")
    whole, coder, rng = bpe.loaded(path), bpe.Encoder(path), random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", " \n", "\t", "'s", "’", "é", "İ", "1", "²", "<|endoftext|>", "!", "日本", "́", "​", "\x85", "\xa0", "\x01", "\U0001f389", "z" * 80, "\x1f"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(800)]
    assert [x.tolist() for x in coder.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [coder.decode(x) for x in coder.encode(texts)] == texts


def test_one_tree_equals_many():
    vocab = bpe.vocabulary(tokenizer("byte_bpe_50k.json"))
    words = [b" international", b"aaaaaaa", b"x", b" the", b"qzqzqzq"]
    packed = bpe.encode_many(vocab, words, 16)
    assert [np.frombuffer(p, vocab.kind).tolist() for p in packed] == [bpe.encode_one(vocab, w) for w in words]


def test_bpe_outputs_and_no_rows(none, docs):
    row = bpe.encode_documents(docs.limit(1), tokenizer("byte_bpe_50k.json")).first()
    assert len(row.ids) == row.n_tokens and row.decoded == docs.where(F.col("doc_id") == row.doc_id).first().text
    assert bpe.encode_documents(none, tokenizer("byte_bpe_50k.json")).count() == 0


# ---- packing


def check_pieces(pieces, texts):
    whole = packing.loaded(tokenizer("word_bpe_49k.json"))
    want = sorted(whole.encode(t or "", add_special_tokens=False).ids + [1] for t in texts)
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    assert sum(n for own in by_sequence.values() for _, n in own) == sum(map(len, want))
    assert len(by_sequence) == max(by_sequence) + 1 == -(-sum(map(len, want)) // packing.LENGTH)
    return by_doc, want


def test_packing_holds_every_id_once(docs):
    pieces = packing.pack(docs, tokenizer("word_bpe_49k.json")).collect()
    by_doc, want = check_pieces(pieces, [r.text for r in docs.collect()])
    made = []
    for own in by_doc.values():
        data = b"".join(bytes(r.ids) for r in sorted(own, key=lambda r: r.start))
        made.append(list(struct.unpack(f"<{len(data) // 4}I", data)))
    assert sorted(made) == want


def test_windows_hold_the_targets(docs):
    pieces = packing.pack(docs, tokenizer("word_bpe_49k.json")).join(docs.select("doc_id", "source"), "doc_id").collect()
    total = sum(r.length for r in pieces)
    share, windows = {}, {}
    for r in pieces:
        share[r.source] = share.get(r.source, 0) + r.length / total
        windows.setdefault(r.sequence_id, {}).setdefault(r.source, []).append(r.length)
    last = max(windows)
    for w, own in windows.items():
        if w != last:
            assert all(abs(sum(own.get(s, [0])) - p * packing.LENGTH) <= 2 for s, p in share.items())


def test_packing_of_odd_rows(odd, none):
    pieces = packing.pack(odd, tokenizer("word_bpe_49k.json")).collect()
    check_pieces(pieces, [r[1] for r in ODD])
    assert packing.pack(none, tokenizer("word_bpe_49k.json")).count() == 0


def test_digest_of_pieces(spark):
    from spanloom.llm.queries import packed_digest

    df = spark.createDataFrame([(1, "hello world", "a")], "doc_id long, text string, source string")
    piece = packing.pack(df, tokenizer("word_bpe_49k.json"))
    ids = packing.loaded(tokenizer("word_bpe_49k.json")).encode("hello world", add_special_tokens=False).ids + [1]
    assert packed_digest(piece).first().ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


# ---- sharding


def test_shards_by_plain_draws(docs):
    def draw(key, nodes, path=""):
        unit = lambda n: (int(hashlib.md5(f"{path}/{n.name}|{key}".encode()).hexdigest()[:13], 16) + 1) / 2**52
        node = min(nodes, key=lambda n: -math.log(unit(n)) / n.weight)
        return node.shard if node.shard is not None else draw(key, node.children, f"{path}/{node.name}")

    rows = sharding.assign(docs, TREE).collect()
    grown = sharding.grown(TREE)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert r.shard == draw(r.doc_id, TREE) and r.grown_shard == draw(r.doc_id, grown)
        assert r.grown_shard in (r.shard, 8)
        assert r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_a_changed_weight_moves_rows_within_its_subtree_alone(spark):
    rows = spark.range(3000)
    lighter = list(TREE)
    rack = lighter[0].children[0]
    changed = sharding.Node(rack.name, rack.weight, (sharding.Node("s0", 3.0, shard=0), *rack.children[1:]))
    lighter[0] = sharding.Node("r0", lighter[0].weight, (changed, *lighter[0].children[1:]))
    both = sharding.place(sharding.place(rows, F.col("id"), TREE), F.col("id"), tuple(lighter), "new_").where("shard <> new_shard").collect()
    assert both and all((r.shard, r.new_shard) == (1, 0) for r in both)


def test_sharding_of_odd_rows(odd, none):
    rows = sharding.assign(odd, TREE).collect()
    assert len(rows) == len(ODD)
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r["size"] for r in rows if r.doc_id == 1} == {1}
    assert sharding.assign(none, TREE).count() == 0


# ---- link graph


@pytest.mark.parametrize(
    "url,host,path,rule",
    [
        ("https://A.example.com/en/1?x", "a.example.com", "/en/1", "example.com/en/"),
        ("https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/"),
        ("http://x.com/fr#top", "x.com", "/fr", "com/"),
        ("http://x.com?q", "x.com", "", None),
        ("http://x.net/es/1", "x.net", "/es/1", "net/es/"),
        ("http://xcom/", "xcom", "/", None),
        ("no scheme", "", "", None),
        (None, "", "", None),
    ],
)
def test_rules(spark, url, host, path, rule):
    row = linkgraph.judge(spark.createDataFrame([(1, url, None)], "page_id long, url string, html string")).first()
    assert (row.host, row.path, row.rule) == (host, path, rule)


def test_a_host_that_links_to_blocked_pages_is_blocked(spark):
    bad = '<a href="http://spam.net/es/1">x</a>' * 3
    rows = [(1, "http://spam.net/es/1", ""), (2, "http://friend.org/x", bad), (3, "http://good.com/x", '<a href="//liked.org/y">'), (4, "http://liked.org/x", None), (5, "http://lone.org/x", "<a href='/in'>")]
    found = {r.page_id: r.verdict for r in linkgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


@pytest.mark.parametrize("hub_links", [1, 100])
def test_ranks_are_carried_on_until_they_settle(spark, hub_links):
    chain = [f"h{i}" for i in range(15)]
    links = [*((a, b, 1.0) for a, b in zip(chain, chain[1:], strict=False)), ("x", "y", 2.0), ("y", "x", 1.0), ("x", "h13", 1.0), ("y", "h5", 3.0), ("h12", "h2", 1.0)]
    seeds = [("h14", 0.0, 1.0), ("x", 0.75, 0.0), ("h8", 0.25, 0.0), ("z", 0.0, 0.0)]
    got = {r.host: (r.trust, r.distrust) for r in linkgraph.settle(spark.createDataFrame(links, "src string, dst string, n double"), spark.createDataFrame(seeds, "host string, good double, bad double"), 0.4, 1e-10, hub_links).collect()}
    hosts = sorted({h for s, d, _ in links for h in (s, d)} | {s for s, _, _ in seeds})

    def solved(edges, seed):
        # by the closed form, the mass of hosts without links returned to the seeds
        n, b = len(hosts), np.array([seed.get(h, 0.0) for h in hosts])
        a = np.zeros((n, n))
        for s, d, w in edges:
            a[hosts.index(d), hosts.index(s)] += w
        a = np.where(a.sum(0) > 0, a / np.maximum(a.sum(0), 1e-300), b[:, None])
        return dict(zip(hosts, np.linalg.solve(np.eye(n) - 0.4 * a, 0.6 * b).tolist(), strict=True))

    trust = solved(links, {h: g for h, g, _ in seeds})
    distrust = solved([(d, s, n) for s, d, n in links], {h: b for h, _, b in seeds})
    assert set(got) == set(hosts)
    for h in hosts:
        assert math.isclose(got[h][0], trust[h], rel_tol=1e-8, abs_tol=0) and math.isclose(got[h][1], distrust[h], rel_tol=1e-8, abs_tol=0)


def test_a_host_far_from_a_blocked_one_is_blocked(spark):
    hosts = [*(f"h{i}.org" for i in range(14)), "spam.net"]
    rows = [(i, f"http://{a}/x", f'<a href="http://{b}/es/1">') for i, (a, b) in enumerate(zip(hosts, hosts[1:], strict=False))] + [(99, "http://spam.net/es/1", "")]
    found = linkgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.verdict for r in found} == {"block"}


def test_the_sql_settles_alike(spark):
    import duckdb

    from spanloom.llm import sql

    rng = random.Random(5)
    hosts = [f"h{i}.{rng.choice(['org', 'net', 'com'])}" for i in range(90)]
    # chains of fifteen, a cycle, and links at random onwards; a repeated row, a long page and a page without one
    pairs = [(a, b) for i, (a, b) in enumerate(zip(hosts, hosts[1:], strict=False)) if i % 15 != 14] + [(hosts[40], hosts[35])] + [tuple(sorted(rng.sample(hosts, 2))) for _ in range(20)]
    rows = [(i, f"http://{a}/{rng.choice(['es', 'fr', 'x'])}/1", f'<a href="//{b}/">', "extra") for i, (a, b) in enumerate(pairs)]
    rows += [rows[0], (900, "http://h3.org/q", "<p>" * 50_000 + '<a href="http://h4.org">', None), (901, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    pages_frame = pages.toPandas()
    with duckdb.connect() as db:
        db.register("pages", pages_frame)
        want = db.execute(sql.link_sql()).fetchall()
    found = [tuple(r) for r in linkgraph.judge(pages).collect()]
    assert sorted(map(str, found)) == sorted(map(str, want)) and {r[4] for r in found} == {"allow", "block"}


def test_link_graph_of_no_rows(spark):
    assert linkgraph.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- nearest neighbours


def test_neighbours_reach_the_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {}
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0, settings=neighbours.Settings(sample_rows=200, list_rows=60)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = table.collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], np.float64)
    hit = []
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        scores[i] = -np.inf
        want = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        found = sorted(got[int(ids[i])])
        assert [r for r, _, _ in found] == list(range(1, 21)) and [s for _, _, s in found] == sorted((s for _, _, s in found), reverse=True)
        hit.append(len(want & {v for _, v, _ in found}) / 20)
    assert np.mean(hit) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    same = [0.5, 0.5]
    rows = [(0, same), (20, same), (40, None), (60, [0.0, 0.0]), (80, [1.0, nan]), (100, [inf, 1.0]), (120, [None, 1.0]), (3, same), (4, [1.0, 0.0]), (5, [-1.0, 0.0]), (None, same), (7, [1.0, 2.0, 3.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    found = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.search(df, F.col("vec_id") % 20 == 0).collect())
    assert found == [(0, 1, 3), (0, 2, 4), (0, 3, 20), (0, 4, 5), (20, 1, 0), (20, 2, 3), (20, 3, 4), (20, 4, 5)]
    assert neighbours.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def ids_of(texts):
    whole = packing.loaded(tokenizer("word_bpe_49k.json"))
    return [whole.encode(x, add_special_tokens=False).ids for x in texts]


def test_words_of_a_batch_split_as_the_library_does(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 100)
    coder, rng = packing.Encoder(tokenizer("word_bpe_49k.json")), random.Random(5)
    parts = ["'s", "'re", "'LL", "'d", "'", "''", "\u2019s", "s", "é", "É", "Ÿ", "İ", "ŉ", "1", "12", "½", "\x85", "\xa0", " ", "\n", "\x00", "\x1f", "€", ",", "the", "日"]
    for _ in range(30):
        texts = ["".join(rng.choices(parts, k=rng.choice([0, 1, 3, 20]))) for _ in range(50)]
        texts += ["it'", "s a new text", "'", "ll", "", "don't 'tis rock'n'roll ''s 's's"]
        assert [x.tolist() for x in coder.encode(texts)] == ids_of(texts)
    for texts in ([], ["", ""], ["日本"], ["a"]):
        assert [x.tolist() for x in coder.encode(texts)] == ids_of(texts)


def test_words_are_remembered_within_bounds(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 200)
    coder, known = packing.Encoder(tokenizer("word_bpe_49k.json")), []
    for i in range(20):
        texts = ["the and of " + " ".join(f"w{'abcdefghij'[j % 10]}x{'klmnopqrstuvwxyz'[j % 16]}{'abcdefghijklmnopqrst'[i]}" for j in range(80))]
        assert [x.tolist() for x in coder.encode(texts)] == ids_of(texts)
        known.append(b"the" in coder.numbers)
        assert len(coder.numbers) == len(coder.bounds) - 1 == len(coder.again) <= 200 + 83
    assert all(known) and coder.bounds[-1] == len(coder.ids)


def test_no_distinct_word_costs_calls_of_its_own():
    """CPU seconds follow the calls: a table of invented prose has a new word in every dozen."""
    coder = packing.Encoder(tokenizer("word_bpe_49k.json"))
    letters = "abcdefghij"
    words = [a + b + c + d + end for a in letters for b in letters for c in letters for d in letters for end in (".", "&&&", "")]
    calls = 0

    def watch(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    texts = [" ".join(words[i : i + 300]) for i in range(0, len(words), 300)]
    sys.setprofile(watch)
    try:
        found = coder.encode(texts)
    finally:
        sys.setprofile(None)
    assert [x.tolist() for x in found] == ids_of(texts)
    assert calls < len(words) / 10
