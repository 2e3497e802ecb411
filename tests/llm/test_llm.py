"""Corpus operators against brute-force versions, exact round trips, held-out accuracy and the awkward cases of their docstrings."""

import hashlib
import random
import re

import numpy as np
import pytest
from parity import check
from pyspark.sql import functions as F

from tastegraph.llm import chat, classify, decontaminate, fingerprint, langid, neardup, pieces, pii, queries, urls

SQL = queries.oracle_sql()
#: Nulls, empty and white-space texts, repeated rows, a null id, a long word, and a column with the name of an output.
ODD = [(1, None, 0.5), (2, "", 0.5), (3, " \t\n ", 0.5), (4, "same text here", 0.1), (4, "same text here", 0.1), (None, "no id", 0.2), (5, "x" * 70_000, 0.3), (6, "日本語 é 🎉 ▁ a", None), (7, "word " * 30_000, 1.0)]
SCHEMA = "doc_id long, text string, SCORE double"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_parity(spark, sf, name):
    assert check(spark, sf, queries.queries()[name], SQL[name]) > 0


# classifiers


@pytest.mark.parametrize("name, label", [("op1_toxicity", "toxic"), ("op7_quality", "quality")])
def test_held_out_accuracy(spark, sf, name, label):
    sf = sf.replace("sf0.001", "sf0.1")
    found = queries.queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (found.predicted == found[label]).mean() > 0.97
    assert ((found.predicted == 1) & (found[label] == 0)).sum() <= 0.02 * (found[label] == 0).sum() + 5
    assert found.score.between(0, 1).all()


def test_classifier_odd_cases(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (7, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    for kind in (classify.TOXICITY, classify.QUALITY):
        named = labels.withColumnRenamed("toxic", kind.label)
        model = classify.fit(odd, named, kind)
        out = classify.score(odd, model, kind)
        assert out.columns == ["doc_id", "text", "score"] and out.count() == len(ODD)
        rows = out.collect()
        assert all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if not (r.text or "")}) == 1
        none = classify.fit(odd, named.limit(0), kind)
        assert {r.score for r in classify.score(odd, none, kind).collect()} == {0.5}
        assert classify.score(empty, none, kind).count() == 0


def test_rows_of_one_id_are_learnt_once(spark):
    """... whatever their number and order: copies of a row change nothing."""
    docs = [(i, f"word{i % 7} other{i % 3} " * (1 + i % 4), None) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    one = classify.fit(spark.createDataFrame(docs, SCHEMA), labels, classify.TOXICITY)
    many = classify.fit(spark.createDataFrame(docs[::-1] * 3, SCHEMA), labels, classify.TOXICITY)
    assert np.array_equal(one[0], many[0]) and np.allclose(one[1], many[1])


def test_word_stems_generalise(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    docs = [(i, " ".join([*(word() for _ in range(20)), "vile" + word()] if i % 3 == 0 else (word() for _ in range(21))), None) for i in range(600)]
    df = spark.createDataFrame(docs, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = classify.fit(df, labels, classify.TOXICITY, F.col("doc_id") < 400)
    seen = classify.score(df.where("doc_id >= 400"), model, classify.TOXICITY).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in seen)


def test_quality_reads_word_pairs(spark):
    """The same words in either class, in pairs that are turned round in one of them."""
    rng = random.Random(1)
    pairs = [(f"{a}one", f"{a}two") for a in ("ba", "be", "bi", "bo", "bu", "da")]
    text = lambda good: " ".join(" ".join(x if good else x[::-1]) for x in rng.choices(pairs, k=20))
    df = spark.createDataFrame([(i, text(i % 2), None) for i in range(600)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    model = classify.fit(df, labels, classify.QUALITY, F.col("doc_id") < 400)
    seen = classify.score(df.where("doc_id >= 400"), model, classify.QUALITY).collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in seen) >= 190


# near duplicates


def families(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    base = [[word() for _ in range(rng.choice([3, 12, 60, 200]))] for _ in range(12)]
    docs = []
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = word()
        docs.append((i, " ".join(w).upper() if i % 7 == 0 else "  ".join(w)))
    return [*docs, (900, None), (901, ""), (902, " \t")]


@pytest.mark.parametrize("seed, n", [(1, 4), (2, 5)])
def test_groups_equal_brute_force(spark, seed, n):
    docs = families(seed)
    got = neardup.groups(spark.createDataFrame(docs, "doc_id long, text string"), n=n).collect()
    want = neardup.brute(docs, n)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_drifting_families(spark):
    """Versions that drift away from one another, each with variants and twins of these at about 0.8."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    docs, now = [], [word() for _ in range(90)]
    for _ in range(10):
        for k in rng.sample(range(90), 3):
            now[k] = word()
        for _ in range(6):
            variant = list(now)
            for k in rng.sample(range(90), rng.choice([0, 1, 2, 3])):
                variant[k] = word()
            twin = list(variant)
            for k in rng.sample(range(90), rng.choice([1, 2, 3])):
                twin[k] = word()
            docs += [" ".join(variant), " ".join(twin)]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    got = neardup.groups(spark.createDataFrame(docs, "doc_id long, text string"), n=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == neardup.brute(docs, 4)


def test_groups_odd_cases(odd, empty):
    got = {r.doc_id: r for r in neardup.groups(odd).collect()}
    assert neardup.groups(odd).count() == len(ODD) and neardup.groups(empty).count() == 0
    assert got[1].n_shingles == got[3].n_shingles == 0 and got[1].component_id == 1 and got[None].component_id is None and got[None].kept
    assert got[4].component_id == 4 and got[7].n_shingles == 1


def test_family_of_a_hub_with_another_hub(spark):
    """Documents 2 and 3 gather around 1, and 1 around 4; neither 2 nor 3 is linked with 1."""
    words = [f"w{i}" for i in range(50)]
    docs = [(1, "a b c d"), (2, " ".join(words)), (3, " ".join([*words[:48], "x", "y"])), (4, "e f g h")]
    members = [(1, 4, 4, 1), (2, 50, 1, 2), (3, 50, 1, 3), (4, 4, 4, 4)]
    found = neardup.family_links(spark.createDataFrame(members, "node long, n long, hub long, component long"), spark.createDataFrame(docs, "doc_id long, text string"), 1, 80)
    assert {tuple(sorted(x)) for x in found.collect()} == {(2, 3)}


def test_texts_of_one_id_are_one_document(spark):
    """Ids 4 has two unlike texts and one without words: its texts are linked, whatever else they are like."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = [(4, a), (4, b), (4, " "), (10, a.upper()), (11, b + " tail"), (2, b), (7, "c d e"), (7, "f g h"), (None, a), (None, b)]
    got = neardup.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got if r.n_shingles and r.doc_id is not None) == [(2, 36, 2), (4, 36, 2), (4, 36, 2), (7, 1, 7), (7, 1, 7), (10, 36, 2), (11, 37, 2)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id == 4 and not r.n_shingles] == [(4, True)]
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None) and len(got) == len(docs)


def test_pairs_across_blocks_of_a_bucket(spark, monkeypatch):
    """However many blocks a bucket has, each pair is met once."""
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(60))) for i in range(40)], "doc_id long, text string").withColumns({"node": F.col("doc_id"), "many": F.lit(False)})
    rows = neardup.profiles(docs.select("doc_id", "node", "many", "text"), 5).drop("doc_id", "many").withColumnsRenamed({"n_shingles": "n"}).withColumns({"key": F.lit(0).cast("long"), "component": F.col("node") % 5, "hub": F.col("node") % 4})
    family = rows.withColumn("component", F.when(F.col("node") < 35, -1).otherwise(F.col("node")))
    for size in (4096, 7):
        monkeypatch.setattr(neardup, "BLOCK_MEMBERS", size)
        got = [tuple(r) for r in neardup.across_pairs(rows, 80).collect()]
        assert sorted(got) == [(a, b) for a in range(40) for b in range(a + 1, 40) if a % 5 != b % 5 and a % 4 != b % 4]
        got = [tuple(r) for r in neardup.across_pairs(family, 80).collect()]
        assert sorted(got) == [(a, b) for a in range(40) for b in range(max(a + 1, 35), 40) if a % 4 != b % 4]


# chat


def test_chat_round_trip(spark):
    rng = random.Random(3)
    parts = ["\\", "#", "<", "</turn>", "<br/>", "### Assistant: ", "\\b", "\\l", "\n", ": ", "é🎉", "", "]", "a"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool]:#", "User"]), rng.choice([None, *["".join(rng.choices(parts, k=6)) for _ in range(3)]])) for c in [*range(40), None] for t in [1, 2, 2, 3, None]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    out = chat.formatted(df)
    null = lambda x: (x is not None, x)
    for r in chat.parsed(out.withColumn("read", chat.masked(F.col("formatted"), F.col("loss_mask")))).collect():
        mine = sorted([(null(t), null(role), text or "") for c, t, role, text in rows if c == r.conv_id])
        assert [(x.role, x.text) for x in r.turns] == [(role[1], text) for _, role, text in mine]
        assert len(r.loss_mask) == len(r.formatted)
        masked = "".join(c for c, m in zip(r.formatted, r.loss_mask, strict=True) if m == "1")
        escaped = lambda s: s.replace("\\", "\\b").replace("#", "\\h").replace("<", "\\l")
        assert masked == "".join(escaped(text) for _, role, text in mine if role[1] == "assistant")
        assert masked == r.read
    assert chat.formatted(df.limit(0)).count() == 0


def test_loss_comes_from_under_the_mask(spark):
    """Many runs, over several slices; another mask gives another digest; a long text and columns named like outputs do no harm."""
    turns = [(1, i, "assistant" if i % 2 else "user", f"t{i}<#\\é") for i in range(401)] + [(2, 0, "user", "q"), (2, 1, "assistant", "a b " * 60_000), (3, 0, "user", "only asks")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit("x"), "loss_mask": F.lit("y"), "turns": F.lit(1)})
    out = chat.formatted(df)
    want = {c: "".join(t for k, _, role, t in turns if k == c and role == "assistant") for c in (1, 2, 3)}
    got = {r.conv_id: (r.loss_chars, r.loss_sha256) for r in chat.digests(out).collect()}
    assert got == {c: (len(t), hashlib.sha256(t.encode()).hexdigest()) for c, t in want.items()}
    wrong = {r.conv_id: r.loss_sha256 for r in chat.digests(out.withColumn("loss_mask", F.concat(F.lit("0"), F.expr("substring(loss_mask, 1, length(loss_mask) - 1)")))).collect()}
    assert wrong[1] != got[1][1] and wrong[2] != got[2][1] and wrong[3] == got[3][1]


# pieces


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as file:
        return file.read()


def test_pieces_equal_the_library(model):
    import sentencepiece

    library, mine = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Pieces(model)
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "ing", "é", "日本", "🎉", "\n", "\t", "12", "A", "tion", "aaa", "...", "https://", "==", "    ", "́"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(1500)] + ["".join(rng.choices("abcdefé", k=5000)), "ab" * 3000, " ", "   x   "]
    for t in texts:
        ids = mine.encode(t).tolist()
        assert ids == library.encode(t) and mine.decode(ids) == t
    assert mine.units.search.widest <= 4 * mine.units.search.longest  # the window, not the text
    assert mine.decode(mine.encode("x▁y").tolist()) == "x▁y"


def test_best_sum_equals_whole_search():
    rng = random.Random(5)
    scores = {p: (i, -rng.random() * len(p)) for i, p in enumerate({"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(60)})}
    search = pieces.BestSum(scores, lambda c: [1000 + ord(c)], -9.0)
    for _ in range(60):
        text = "".join(rng.choices("abcd", k=rng.randint(0, 60)))
        best = [(0.0, [])] + [(-np.inf, [])] * len(text)
        for e in range(1, len(text) + 1):
            options = [(best[s][0] + scores[text[s:e]][1], [*best[s][1], scores[text[s:e]][0]]) for s in range(max(0, e - 5), e) if text[s:e] in scores]
            if text[e - 1] not in scores:
                options.append((best[e - 1][0] - 9.0, [*best[e - 1][1], 1000 + ord(text[e - 1])]))
            best[e] = max(options, key=lambda x: x[0])
        assert search.encode(text) == best[-1][1]


def test_pieces_odd_cases(odd, empty):
    out = pieces.encode(odd)
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r.round_trip for r in rows) and {r.n_ids for r in rows if not r.text} == {0}
    back = pieces.decode(out.select("doc_id", "ids"))
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((d or 0, t or "") for d, t, _ in ODD)
    assert pieces.encode(empty).count() == 0


# fingerprints


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distances():
    rng = random.Random(2)
    pairs = [("".join(rng.choices("ABCD", k=rng.randint(1, 64))), "".join(rng.choices("ABCD", k=rng.randint(1, 64)))) for _ in range(300)]
    assert fingerprint.distances(*map(list, zip(*pairs, strict=True))).tolist() == [levenshtein(a, b) for a, b in pairs]


def test_edited_texts_are_near(spark, sf):
    found = queries.op5_fingerprints(spark, sf).orderBy("doc_id").collect()
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    for (doc, text), (_, after), r in zip(docs, docs[1:] + docs[:1], found, strict=True):
        cut = len(text) // 4
        assert (r.doc_id, r.n_chars) == (doc, len(text))
        assert r.edited_sha256 == hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()
    assert np.mean([r.near_edited > r.near_next for r in found]) > 0.98 and np.mean([r.near_edited for r in found]) > 0.6


def test_repetitive_texts_stay_near(spark):
    text = "In. " * 900
    other = " ".join(f"w{i * 7919 % 1000}" for i in range(900))
    a, b = fingerprint.fingerprint(np.frombuffer(text.encode(), np.uint8)), fingerprint.fingerprint(np.frombuffer(fingerprint.edit(text, other).encode(), np.uint8))
    assert fingerprint.likeness([a], [b])[0] > 0.4


def test_next_texts_over_many_ranges(spark):
    """An id that fills ranges, null ids, a very long text, one range and many: the order is by id, then by the text's hash."""
    rng = random.Random(3)
    docs = [(rng.choice([5, 5, None, rng.randint(-50, 50)]), f"text {i} " * rng.randint(0, 9)) for i in range(400)] + [(7, "long " * 20_000), (8, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("RANGE", F.lit("clash"))
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.o, r.t)
    order = sorted(df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("o", F.shiftrightunsigned(F.xxhash64("t"), 1)).collect(), key=key)
    want = sorted((r.doc_id is not None, r.doc_id or 0, len(r.t), hashlib.sha256(fingerprint.edit(r.t, after.t).encode()).hexdigest()) for r, after in zip(order, order[1:] + order[:1], strict=True))
    for n in (1, 2, 60):
        got = fingerprint.edited(df, ranges=n).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) == want


def test_fingerprint_is_what_its_rules_say():
    """Chunks and characters again, byte by byte."""
    mix = lambda x: int(fingerprint.W.mix(np.array([x % 2**64], np.uint64))[0])
    value = [int(x) for x in fingerprint._ROLL]
    prime, base = 0x9E3779B97F4A7C15, int(fingerprint.W._P)

    def level(b, i):
        h = mix(sum(value[b[i - k]] * pow(prime, k, 2**64) for k in range(min(fingerprint.SPAN, i + 1))))
        return 64 if h == 0 else (h & -h).bit_length() - 1

    def signature(b, k):
        cuts, last = [], 0
        for i in range(1, len(b) + 1):
            if (i - last >= max(1, (1 << k) // 4) and level(b, i - 1) >= k) or i - last == 4 << k or i == len(b):
                cuts.append((last, i))
                last = i
        char = lambda s, e: chr(fingerprint._CHARS[mix(sum(value[b[i]] * pow(base, i - s, 2**64) for i in range(s, e)) + e - s) >> 58])
        return "".join(char(s, e) for s, e in cuts)

    rng = random.Random(4)
    for text in ["a", "ab" * 40, "".join(rng.choices("abcd é", k=700)), " ".join(rng.choices(["lorem", "ipsum", "dolor"], k=300))]:
        b = text.encode()
        k = max(0, (len(b) - 1) // fingerprint.USUAL).bit_length()
        while len(signature(b, k)) > fingerprint.LENGTH:
            k += 1
        assert fingerprint.fingerprint(np.frombuffer(b, np.uint8)) == f"{k}:{signature(b, k)}:{signature(b, k + 1)}"


def test_fingerprint_odd_cases(spark, odd, empty):
    rows = fingerprint.annotate(odd).collect()
    assert len({r.fingerprint for r in rows if not r.text}) == 1 and len({r.fingerprint for r in rows if r.doc_id == 4}) == 1
    assert fingerprint.edited(odd).count() == len(ODD) and fingerprint.edited(empty).count() == 0
    assert fingerprint.edited(odd.where("doc_id = 7")).first().near_next == 1.0


# URLs


def test_explicit_rules(spark):
    cases = {
        "http://a.org/x": ("a.org", "/x", "org/", "allow"),
        "http://org/": ("org", "/", "org/", "allow"),
        "https://WWW.Example.org/es/1?q": ("www.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/10": ("example.org", "/en/10", "example.org/en/1", "block"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "ftp://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
        "http://x.com/de/a#b": ("x.com", "/de/a", "com/de/", "block"),
        "http://a.org": ("a.org", "", None, "allow"),
        "http://a.org?x/y": ("a.org", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.judge(df.limit(0)).count() == 0


def test_mined_rules_match_whole_antecedents(spark):
    labelled = [(["host:bad", "x"], "block")] * 30 + [(["host:ok", "x"], "allow")] * 30 + [(["a", "b"], "block")] * 20 + [(["a"], "allow")] * 20 + [(["b"], "allow")] * 20
    df = spark.createDataFrame(labelled, "tokens array<string>, verdict string")
    rules = urls.mine(df, df)
    assert urls.mine(df, df.where("verdict = 'allow'")).count() == 0  # what doesn't hold on other URLs is dropped
    assert {tuple(r.antecedent) for r in rules.collect()} == {("host:bad",), ("a", "b")}
    sets = spark.createDataFrame([(["a"],), (["a", "b", "c"],), (["host:bad", "z"],), (["q"],)], "tokens array<string>")
    assert {tuple(r.tokens) for r in urls.fired(sets, rules).collect()} == {("a", "b", "c"), ("host:bad", "z")}


def test_labels_of_the_caller(spark):
    """Hosts that the caller blocks are learnt and measured on URLs kept apart; a very long url, nulls and odd labels do no harm."""
    rows = [(i, f"http://{'bad' if i % 3 == 0 else 'ok'}{i % 2}.net/p{i}?x{i % 4}=1", "block" if i % 3 == 0 else "allow") for i in range(900)]
    rows += [(1000, "http://bad0.net/" + "a/" * 50_000, None), (1001, "http://ok1.net/", "?"), (1002, None, "block"), (1003, "http://x.com/de/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = {r.page_id: r.verdict for r in urls.judge(df, label_column="verdict").collect()}
    assert (got[1000], got[1001], got[1002], got[1003], got[3], got[4]) == ("block", "allow", "allow", "block", "block", "allow")
    m = urls.measured(df, label_column="verdict").first()
    assert m.n > 100 and m.blocked == m.right == m.block


# languages


def test_language_held_out(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    found = queries.op8_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97


def test_codewords_and_odd_cases(spark, odd, empty):
    for n in (2, 3, 7, 12, 300):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n and all(abs(c.sum()) < n for c in code.T)
    docs = [(i, t * (1 + i % 3), lang) for i in range(40) for t, lang in (("the cat and the dog ", "en"), ("der hund und die katze ", "de"))]
    learnt = langid.fit(spark.createDataFrame([*docs, (99, "x", None), (98, None, "fr")], "doc_id long, text string, lang string"))
    got = langid.predict(odd, learnt).collect()
    assert {r.lang_pred for r in got if not (r.text or "").strip()} == {"und"} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(ODD)
    nothing = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"} and langid.predict(empty, learnt).count() == 0


def test_rare_languages_are_learnt(spark, monkeypatch):
    """No language is left out, however many there are."""
    word = lambda k: "".join(chr(97 + (k * 7 + j * (k % 11 + 1)) % 26) for j in range(5))
    docs = [(k * 50 + i, " ".join([word(k), word(k)[::-1]] * 5), f"l{k:03d}") for k in range(60) for i in range(40 if k % 2 else 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    langs, weights, _ = langid.fit(df, max_rows=100)
    assert langs == [f"l{k:03d}" for k in range(60)]
    monkeypatch.setattr(langid, "BROADCAST_LANGS", 1)
    assert np.array_equal(langid.fit(df, max_rows=100)[1], weights)


# decontamination


def test_decontamination_equals_brute_force(spark, odd, empty):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)] + ["É", "ab"]
    line = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=n))
    items = [(i, line(rng.choice([1, 3, 12, 13, 14, 40]) if i else 60)) for i in range(25)] + [(50, ""), (51, None), (52, "...")]
    docs = [(d, " ".join([line(rng.randint(0, 80)), rng.choice(items)[1] or "", line(rng.randint(0, 30)).upper()])) for d in range(120)] + [(500, None), (501, "")]
    want = decontaminate.brute(docs, items)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_CHARS, 200):
        got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.find(df, bench, block_chars=block).collect()}
        assert got == want
    assert decontaminate.find(odd, bench).count() == len(ODD) and decontaminate.find(empty, bench).count() == 0
    assert decontaminate.find(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_benchmark_blocks_end_and_are_bounded(spark):
    items = [("a", "x" * 8)] * 3 + [(str(i), "y" * (i % 5)) for i in range(60)] + [("long", "z" * 50)]
    dealt, numbers = decontaminate.blocks(spark.createDataFrame(items, "item_id string, text string"), "item_id", "text", 10)
    sizes = {(r.part, r.block): r.n for r in dealt.groupBy("part", "block").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert sorted(sizes) == numbers and max(sizes.values()) <= 10 + 50 and dealt.count() == len(set(items))


def test_a_line_that_all_items_share(spark):
    """... and that a document repeats: no pair of places is made, and items and words are right."""
    line = " ".join(f"s{k}" for k in range(20))
    items = [(i, f"{line} own{i} tail{i}") for i in range(400)]
    docs = [(0, " ".join([line] * 500)), (1, f"x {line} y"), (2, "own3 tail3"), (3, " ".join(line.split()[:12]))]
    index = decontaminate.Index.of([str(i) for i, _ in items], [t for _, t in items])
    words = decontaminate.W.split(*decontaminate.W.buffers(decontaminate.pa.array([docs[0][1]])), decontaminate.W.ALNUM)
    assert len(decontaminate.Matcher(index).hits(words)[0]) == 500 * 8
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == decontaminate.brute(docs, items)


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_by_definition(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return (
        [("email", *m.span()) for m in EMAIL.finditer(t)]
        + [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        + [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits(m[0])[::-1])) % 10 == 0]
        + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]
    )


def test_base_spans_equal_the_definition(spark, sf):
    rng = random.Random(6)
    parts = ["a@b.c", "@", ".", "-", "+1 (", "555", "0", "255", "256", "1.2.3.4", " ", "4111111111111111", "4111-1111 1111 1111", "x", "é", "%", "(", ")", "+49 30 1234567", "٣"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(4000)]
    texts += [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for t in texts:
        assert pii.base_spans(t) == base_by_definition(t), t


def test_candidates_are_judged(odd, empty):
    model, thresholds = pii.fit()
    find = lambda t: [(k, t[s:e]) for k, s, e in pii.find(t, model, thresholds)[1]]
    assert ("phone", "(555) 123-4567") in find("please call me, phone (555) 123-4567 today")
    assert any(k == "iban" for k, _ in find("pay to iban DE89 3704 0044 0532 0130 00 now"))
    assert any(k == "email" for k, _ in find("write to jane.doe [at] example [dot] com please"))
    for clean in ("on 2024-05-17 we met", "version 12.34.56 of the tool", "isbn 978-3-161-48410-0 in print", "order 12345-67890-123 shipped"):
        assert find(clean) == []
    for kind, text in (("phone", "Tel. 0301234567"), ("phone", "tel 5551234567"), ("ip", "dead:beef::cafe"), ("ssn", "ssn 123 45 6789")):
        assert [k for k, _ in find(text)] == [kind]
    assert ("phone", 4, 14) in pii.candidates("at, 0301234567 2024 x") and ("phone", 4, 15) in pii.candidates("at, 030 1234567 2024 12 x")
    rates = pii.measured(400)
    assert all(found > 0.6 * of for kind, (found, of) in rates.items() if kind != "look-alikes") and rates["look-alikes"][0] < 0.25 * rates["look-alikes"][1]
    letters = odd.sparkSession.createDataFrame([(1, "at dead:beef::cafe it is"), (2, "so: no")], "doc_id long, text string")
    assert [len(r.pii_spans) for r in pii.annotate(letters).orderBy("doc_id").collect()] == [1, 0]
    both = "a@b.co and a@b.co"
    assert pii.redacted(both, pii.base_spans(both)) == "[EMAIL] and [EMAIL]"
    out = pii.annotate(odd, redact=True)
    assert out.count() == len(ODD) and out.where("size(pii_spans) > 0").count() == 0 and pii.annotate(empty).count() == 0


# pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, kept = docs, {}
    for name, stage in p.STAGES:
        at = stage(spark, at, sf).cache()
        kept[name] = {r.doc_id for r in at.select("doc_id").collect()}
        assert at.count() == len(kept[name]) and (name == p.STAGES[-1][0] or at.columns == docs.columns)
    order = [kept[n] for n, _ in p.STAGES]
    assert all(b <= a for a, b in zip(order, order[1:], strict=False)) and len(order[-1]) > 0.5 * docs.count()
    assert order[3] == order[4] and {r.doc_id for r in p.run(spark, sf).collect()} == order[-1]
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept["quality"]]
    assert kept["near_duplicates"] == {d for d, (_, c) in neardup.brute(rows, 5).items() if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = decontaminate.brute([x for x in rows if x[0] in kept["near_duplicates"]], items)
    assert min(len(t.split()) for _, t in items) >= decontaminate.WINDOW  # so every hit is a whole window
    assert kept["decontaminate"] == {d for d, (_, hit, _) in clean.items() if not hit}


def test_pipeline_drops_planted_passages(spark, tmp_path):
    """A passage of 13 words goes with its document, however long; 12 words and single words of short items don't."""
    import corpus_pipeline as p

    rng = random.Random(8)
    filler = lambda n: " ".join("f" + "".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    item = " ".join(f"q{i}" for i in range(30))
    spark.createDataFrame([("x", item), ("x", item), ("short", "a b"), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = {
        1: f"{filler(5000)} {' '.join(f'Q{i}' for i in range(9, 22))} {filler(5000)}",
        2: f"{filler(5000)} {' '.join(f'q{i}' for i in range(9, 21))} {filler(5000)}",
        3: f"{filler(300)} a b {filler(300)}",
        4: "so a b",
        5: filler(400),
    }
    df = spark.createDataFrame([*docs.items(), (6, None), (7, "")], "doc_id long, text string")
    assert {r.doc_id for r in p.decontaminated(spark, df, str(tmp_path)).collect()} == {2, 3, 5, 6, 7}


def test_pipeline_stages_keep_the_callers_columns(spark, sf):
    """Nulls, repeated rows, and columns with every name that a stage uses inside."""
    import corpus_pipeline as p

    text = " ".join(f"word{i}" for i in range(60)) + " mail a@b.co"
    names = ["row", "score", "_text", "_quality", "_id", "_row", "node", "many", "hash", "place", "id", "n_words", "n_hit", "item_ids", "hit_spans", "whole_window", "base_spans", "pii_spans", "none"]
    rows = [(1, text, 3), (1, text, 4), (2, None, 5), (3, "", 6), (4, "  ", 7), (None, text + " more", 8), (5, "short one", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").select("*", *[(F.col("n_chars") * 100 + i).alias(n) for i, n in enumerate(names)])
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, df, sf)
        found = out.collect()
        assert out.columns == df.columns and stage(spark, df.limit(0), sf).count() == 0
        for r in found:
            mark = r["row"] // 100 if r["row"] is not None else None
            assert all(r[n] == (None if mark is None else mark * 100 + i) for i, n in enumerate(names))
            assert r.text == next(t if name != "personal_data" else t and t.replace("a@b.co", "[EMAIL]") for d, t, k in rows if k == mark)
        if name == "near_duplicates":  # the null id stands below zero, so it is the group's least
            assert sorted(r.doc_id or 0 for r in found) == [0, 2, 3, 4, 5]
        elif name != "quality":
            assert len(found) == len(rows)
    assert p.tokens(spark, df, sf).count() == len(rows)


def test_pipeline_keeps_unlike_texts_of_one_id(spark):
    import corpus_pipeline as p

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = [(1, a), (1, b), (1, b), (1, b.upper()), (2, b), (3, c), (3, c), (4, ""), (4, " "), (4, None)]
    found = p.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    assert sorted((r.text or "").lower().strip() for r in found) == ["", a, b, c]
