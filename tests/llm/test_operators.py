"""Each corpus operator against a plain restatement, and its defined cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("tracewright.llm")

import xxhash  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tracewright.llm import exact_dedup, language, mixing, near, pages, pii, simhash, toxicity, winnowing  # noqa: E402


# -- winnowing ----------------------------------------------------------------------------------------------------------
def _winnowed(text):
    """Hash and position of each window's rightmost least k-gram, one gram after the other."""
    hashes = [(xxhash.xxh64_intdigest(t.encode(), 42) & 0x7FFFFFFF) % winnowing.PRIME for t in re.findall(winnowing.TOKEN, text or "", re.A)]

    def value(gram):
        total = 0
        for x in gram:
            total = (total * winnowing.BASE + x) % winnowing.PRIME
        return total

    if not hashes:
        return []
    grams = [value(hashes[i : i + 8]) for i in range(len(hashes) - 7)] or [value(hashes)]
    kept = []
    for i in range(max(1, len(grams) - 7)):
        window = grams[i : i + 8]
        at = i + max(k for k, g in enumerate(window) if g == min(window))
        if not kept or kept[-1][1] != at:
            kept.append((grams[at], at))
    return kept


def test_winnowing_equals_brute_force_for_any_ids(spark):
    rng = random.Random(3)
    run = "".join(rng.choice("abcdefghij") for _ in range(3000))
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(60)))) for i in range(30)]
    rows += [(100, run), (99, "Z" + run), (98, None), (97, ""), (96, "漢字" * 30 + " ab"), (None, "x y"), (-6 * 10**18, "a b c"), (6 * 10**18, "a b c"), (10**15, "far")]
    got = {r.doc_id: r for r in winnowing.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    order = [*sorted((i for i in text if i is not None), reverse=True), None]
    for k, i in enumerate(order):
        t, following = text[i] or "", text[order[(k + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for kept, fingerprint, positions in ((_winnowed(t), got[i].fingerprint, got[i].positions), (_winnowed(edited), got[i].edited_fingerprint, got[i].edited_positions)):
            assert fingerprint == "".join(f"{h:08x}" for h, _ in kept) and positions == [p for _, p in kept]
        a, b = ({h for h, _ in _winnowed(x)} for x in (t, following))
        assert got[i].near_next == (len(a & b) / len(a | b) if a | b else 1.0)
    assert got[100].near_next > 0.95  # one letter more in front moves nothing


def test_winnowing_deals_hot_and_random_ids_evenly(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.xxhash64("id")).alias("doc_id"), F.concat(F.lit("t "), F.col("id").cast("string")).alias("text"))
    d = winnowing._blocked(rows.select("*", F.bitwise_not("doc_id").alias("down"), F.xxhash64("text").alias("th")))
    assert d.groupBy("block").count().agg(F.max("count")).first()[0] < 2500
    got = winnowing.fingerprint_edits(rows)
    assert got.count() == 9000
    # blocks follow each other in the order of the rows
    per = d.groupBy("block").agg(F.min(F.struct("down", "th")).alias("lo"), F.max(F.struct("down", "th")).alias("hi")).orderBy("block").collect()
    assert all(tuple(a.hi) <= tuple(b.lo) for a, b in zip(per, per[1:], strict=False))


# -- pages --------------------------------------------------------------------------------------------------------------
_SAID = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div class="post-content share">{_SAID}</div>', _SAID),
        (f'<article><p>{_SAID}</p><p class="legal">Some legal words.</p></article>', f"{_SAID} Some legal words."),
        (f"<nav><a href=x>Home</a></nav><div><h1>The title</h1><p>{_SAID}</p><ul><li>one two</li></ul><p>{_SAID}</p><p>Short end.</p></div><footer>c me</footer>", f"The title {_SAID} one two {_SAID} Short end."),
        (f"<article><p>İstanbul {_SAID}</p><SCRIPT>var a = '</p>';</Script><p>tail</p></article>", f"İstanbul {_SAID} tail"),
        (f'<div class="site has-sidebar"><div class="sidebar-wrapper"><article><header class="entry-header"><h1>Head line</h1></header><p>{_SAID}</p></article></div><div class="sidebar">junk</div></div>', f"Head line {_SAID}"),
        (f'<article><p>{_SAID}</p><div class="comments"><p>{_SAID} nice</p></div><aside>Side</aside></article>', _SAID),
        (f'<p>{_SAID}</p><div class="newsletter"><p>Sign up today for news and more of it all.</p></div>', _SAID),
        (f"<article><p>{_SAID}</p><form><p>Your name</p></form><style>p{{}}</style><!-- <p>no</p> --><p>a &lt; b&nbsp;c &#233;</p></article>", f"{_SAID} a < b c é"),
    ],
)
def test_pages_come_out_whole(page, want):
    assert pages.main_text(f"<html><body>{page}</body></html>") == want


def test_the_tree_asks_for_both_neighbours():
    asked = set()

    def walk(node):
        if isinstance(node, tuple):
            asked.add(pages.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(pages.tree())
    assert {"words", "density", "words before", "density before", "words after", "density after"} <= asked
    assert all(pages._classify(r[:-1]) == bool(r[-1]) for r in pages.LABELLED)


def test_pages_equal_a_plain_extractor(spark):
    """Pages of one article among furniture: what stands in the article element, without tags."""
    import html

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in pages.extract(rows).collect()}
    for r in rows.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br|li|ul)[^>]*>", " ", inner))).split())
        assert got[r.page_id] == (text, len(text))


def test_pages_defined_cases(spark):
    page = f"<article><p>{_SAID}</p></article>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", page[:-40]), (4, "x", f"<article>{'<p>' + _SAID * 300 + '</p>'}</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(0))
    got = sorted(((r.page_id or 0, r.url, r.text) for r in pages.extract(df).collect()), key=str)
    assert len(got) == 6 and [t for i, _, t in got if i == 1] == [_SAID, _SAID]
    assert [t for i, _, t in got if i in (0, 2)] == ["", ""] and next(t for i, _, t in got if i == 3).startswith("word0")
    assert next(len(t) for i, _, t in got if i == 4) == len(_SAID * 300)
    assert pages.extract(df.limit(0)).count() == 0


# -- surrogates ---------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text",
    ["Password: hunter22xyz", "API_KEY=abcdef123456", 'access_token="abc123def"', "call 555 123 4567 now", "Tel 0171 5551234", "at fe80::1ff:fe23:4567:890a", "SSN 123 45 6789", "met Anna Schmidt", "my name is Zoran Petrovic", "pay 4111 1111 1111 1111", "mail a.b@c.org", "from 10.20.30.40"],
)
def test_nothing_leaks(text):
    got, n, _ = pii.rewrite(text, b"k" * 32, {})
    secret = text.split(maxsplit=1)[-1].split("=")[-1].strip('"')
    assert n == 1 and got != text and secret not in got
    assert [c.isdigit() for c in got] == [c.isdigit() for c in text] or not re.fullmatch(r"[\d ]+", secret)


@pytest.mark.parametrize("text", ["order 1234567890123 shipped", "std::vector<a::b>", "the secret: patience", "Mark my words, Paris is nice.", "in 2024 about 12 345 people"])
def test_no_false_hits(text):
    assert pii.rewrite(text, b"k" * 32, {})[:2] == (text, 0)


def test_one_person_has_one_name():
    got, n, kinds = pii.rewrite("Dr Anna Schmidt met Mrs Anna Schmidt. Later Anna left; Mrs Schmidt too. Anna Schmidt!", b"k" * 32, {})
    given, family = re.match(r"Dr (\w+) (\w+) met", got).groups()
    assert got == f"Dr {given} {family} met Mrs {given} {family}. Later {given} left; Mrs {family} too. {given} {family}!" and n == 5 and kinds == ["person"]
    assert given in pii.GIVEN["latin", "f"]


def test_ten_thousand_people_stay_distinct(spark):
    names = sorted({f"{a}{b}{c}{d}" for a in "BDFGKLMNPR" for b in "aeiou" for c in "bdfglmnprst" for d in ("a", "en", "is", "or", "ul", "ek", "ax", "ip", "om", "yr", "et", "ad", "os", "uv", "il", "ob", "an", "er", "it")})[:10_000]
    assert len(names) == 10_000
    df = spark.createDataFrame([(i, f"then Herr {n} spoke") for i, n in enumerate(names)], "doc_id long, text string")
    got = [r.text[10:-6] for r in pii.surrogates(df, "k").collect()]
    assert len(set(got)) == len(names) and not set(got) & set(names)
    few = df.limit(300)
    plain, joined = ({r.doc_id: r.text for r in pii.surrogates(few, "k", most_moved=m).collect()} for m in (200_000, 3))
    assert plain == joined and len(set(joined.values())) == 300


def test_gender_follows_the_corpus(spark):
    df = spark.createDataFrame([(1, "Mrs Kim Lee came"), (2, "we saw Mrs Kim Lee"), (3, "Dr Kim Lee said so")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.surrogates(df, "k").collect()}
    given = got[1].split()[1]
    assert given in pii.GIVEN["latin", "f"] and got[3].split()[1] == given and got[2].split()[3] == given


# -- toxicity -----------------------------------------------------------------------------------------------------------
def _osa(a, b):
    """Edits between two words, neighbours that change places counting one."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_the_automaton_is_the_plain_edit_distance():
    rng = random.Random(4)
    terms = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(5, 8))) for _ in range(12)})
    lexicon = toxicity.Lexicon(terms, [], terms, [])
    words = {"".join(rng.choice("abcde") for _ in range(rng.randrange(3, 10))) for _ in range(3000)}
    for t in terms:
        for _ in range(60):
            w = list(t)
            k = rng.randrange(len(w) - 1)
            w[k : k + 2] = rng.choice(([w[k + 1], w[k]], [w[k]], [w[k], "e", w[k + 1]], ["e", w[k + 1]]))
            words.add("".join(w))
    for w in words:
        least = min(_osa(w, t) for t in terms)
        assert lexicon.read(w) == (toxicity.EXACT if least == 0 else toxicity.FUZZY if least == 1 else 0), w


def test_words_below_a_stem_may_be_misspelled():
    rng = random.Random(9)
    filler = [f"{a}{b}{c}" for a in ("ba", "ke", "ti", "lo") for b in ("ra", "no", "mi") for c in ("st", "ll", "nd")]
    text = lambda *extra: " ".join(rng.sample([*rng.choices(filler, k=40), *extra], 40 + len(extra)))
    rows = [(1, text(rng.choice(["dumbhead", "dumbheads", "dumbheaded"]))) for _ in range(150)] + [(0, text()) for _ in range(200)]
    lexicon, _ = toxicity.learn(rows)
    assert lexicon.stems and lexicon.read("dumbheads") == toxicity.STEM
    for inside in ("dubmhead", "dmbheads", "dunbheaded", "udmbhead"):  # the edit stands in the stem itself
        assert lexicon.read(inside) == toxicity.FUZZY


def test_toxicity_fit_keeps_long_texts_and_rows_pass_whole(spark):
    rng = random.Random(2)
    filler = [f"{a}{b}" for a in ("bra", "keno", "timi", "lost") for b in ("st", "ll", "nd", "rk")]
    long_ = lambda *extra: " ".join([*rng.choices(filler, k=9000), *extra])
    rows = [(i, long_("grumbold") if i % 4 == 0 else long_()) for i in range(160)] + [(1000, "grumbold"), (1000, "kenost"), (None, "grumbold now"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int")
    kept = toxicity.without_toxic(d, labels)
    assert kept.columns == d.columns
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id = 1000").collect()) == [(1000, "kenost")] and [r.text for r in kept.where("doc_id is null").collect()] == [None]
    assert sorted(r.doc_id for r in kept.where("doc_id < 1000").collect()) == [i for i in range(160) if i % 4]


# -- language -----------------------------------------------------------------------------------------------------------
def test_a_language_of_long_texts_is_learned(spark):
    rows = [(i, "kami kato mika toki " * 20, "aa") for i in range(30)] + [(100 + i, "zweln brund stolm grelb " * 3000, "bb") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r.doc_id >= 100, r.lang_pred) for r in language.identify(d).collect()} == {(False, "aa"), (True, "bb")}
    plain = language.Mixture.fit([(lang, t) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1])
    fitted = language.fit(d)  # counted by the tasks, from the same rows
    assert fitted.langs == plain.langs and np.allclose(fitted.table, plain.table)


def test_mixture_proportions_equal_a_plain_em():
    rows = [("aa", "kami kato mika toki " * 30), ("bb", "zweln brund stolm grelb " * 30), ("cc", "oude feyi wuxo jaqe " * 30)]
    m = language.Mixture.fit(rows)
    words = "kami toki zweln mika brund kato stolm toki grelb mika".split()
    s = m.words(" ".join(words)).astype(float)
    share = m.infer(m.words(" ".join(words)), np.zeros(len(s), int), 1)[0]
    like = np.exp(s - s.max(1, keepdims=True))
    pi = np.array([0.5, 0.5, 0.0])
    for _ in range(200):
        post = like * pi
        pi = (post / post.sum(1, keepdims=True)).mean(0)
    assert np.abs(share - pi).max() < 0.02 and share[2] == 0


# -- mixing -------------------------------------------------------------------------------------------------------------
def test_seventy_domains_all_take_part(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"d{i % 70}w{rng.randrange(20)}" if rng.random() < 0.7 else f"c{rng.randrange(200)}" for _ in range(40)), f"dom{i % 70:02d}") for i in range(1400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    weights = {f"dom{k:02d}": 1.0 + k for k in range(70)}
    got = mixing.mix(d, d, weights=weights).collect()
    assert len({r.domain for r in got}) == 70 and got[0].miss <= mixing.TOLERANCE
    totals = np.sum([np.array(r.posterior) * r.n_tokens * r.rate for r in got], axis=0)
    want = np.array([weights[k] for k in sorted(weights)])
    assert np.abs(totals / totals.sum() - want / want.sum()).max() < 2e-3 and min(r.rate for r in got) >= 0


def test_rates_meet_what_a_plain_solver_meets(spark):
    """Middling posteriors and hard targets: the miss is that of nonnegative least squares by plain projected steps."""
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.6] * 4, 600)
    n = rng.integers(20, 200, 600)
    m = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>").coalesce(1).cache()
    totals = (n[:, None] * p).sum(0)
    for target in (np.full(4, totals.sum() / 4), np.array([0.7, 0.1, 0.1, 0.1]) * totals.sum()):
        steps, miss = mixing.fit_rates(m, target)
        assert miss <= mixing.TOLERANCE
        r = np.ones(600)
        for y in steps:
            r = np.maximum(0.0, r - p @ np.array(y))
        got = m.withColumn("r", mixing.rate_column(steps, 0.0)).select("r").toPandas()["r"].to_numpy()
        assert np.allclose(got, r) and np.abs((n * r) @ p - target).max() <= mixing.TOLERANCE * target.sum() * 1.01
    many = [[0.001 * k, 0.0, -0.001, 0.0] for k in range(100)]  # beyond FEW_TERMS rates are folded over an array
    r = np.ones(600)
    for y in many:
        r = np.maximum(0.0, r - p @ np.array(y))
    assert np.allclose(m.withColumn("r", mixing.rate_column(many, 0.0)).select("r").toPandas()["r"].to_numpy(), r)


def test_mixing_defined_cases(spark):
    d = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "y"), (None, "", None), (3, "c d", "y")], "doc_id long, text string, domain string").withColumn("p", F.lit("clash")).withColumn("rate", F.lit("clash"))
    got = mixing.mix(d, d.select("doc_id", "text", "domain")).collect()
    assert len(got) == 5 and len({(r.rate, r.copies) for r in got if r.doc_id == 1}) == 1 and {r.n_tokens for r in got if r.doc_id in (2, None)} == {0}
    assert all(r.domain == "all" and r.rate == 1 for r in mixing.mix(d, d.select("doc_id", "text", F.lit(None).cast("string").alias("domain"))).collect())
    for weights, whole in (({"z": 1.0}, False), ({"x": -1.0}, False), ({"x": 1.0}, True)):
        with pytest.raises(ValueError):
            mixing.mix(d, d.select("doc_id", "text", "domain"), weights=weights, whole=whole)


# -- fingerprints and copies -------------------------------------------------------------------------------------------
def _simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprint_is_the_restated_one():
    rng = random.Random(8)
    texts = [None, "", " \t\n", "One", "one two", "É é ÄÖ", "a b c d", *(" ".join(rng.choice("abc DEF é x\ty\x0bz".split(" ")) for _ in range(rng.randrange(40))) for _ in range(200))]
    assert [simhash.fingerprint(t) for t in texts] == [_simhash(t) for t in texts]


def test_a_snapshot_is_built_once_and_screens_later_batches(spark, tmp_path):
    rows = [(i, f"text number {i % 40}") for i in range(60)] + [(None, "Only null id"), (70, None)]
    path = str(tmp_path / "snapshot")
    exact_dedup.Snapshot.build(spark.createDataFrame(rows, "doc_id long, text string"), path, bucket_keys=7)
    batch = [(100, "TEXT NUMBER 3"), (101, "fresh"), (102, "Fresh"), (103, ""), (104, "only NULL id"), (None, "alone"), (105, "text number 39")]
    snapshot = exact_dedup.Snapshot.open(spark, path)
    for _ in range(2):  # the snapshot is not changed by a batch
        got = {r.doc_id: (r.keep_id, r.new) for r in snapshot.screened(spark.createDataFrame(batch, "doc_id long, text string")).collect()}
        assert got == {100: (43, False), 101: (102, False), 102: (102, True), 103: (70, False), 104: (None, False), None: (None, True), 105: (39, False)}


def test_whole_rows_without_copies(spark):
    rows = [(1, "Unique text kept", None), (1, "same", 5), (9, "SAME é", 7), (9, "same É", 8), (None, "x", 1), (None, "X", 2), (4, "x", 3), (4, "x", 3), (6, None, 1), (7, "", 1), (None, "aLone é", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, norm int").withColumn("digest", F.lit("clash"))
    got = exact_dedup.without_copies(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id or 0, r.text) for r in got.collect()), key=str) == sorted([(1, "Unique text kept"), (1, "same"), (9, "SAME é"), (9, "same É"), (4, "x"), (7, ""), (0, "aLone é")], key=str)
    assert exact_dedup.without_copies(df.limit(0)).count() == 0


def test_whole_rows_without_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(900)}" for _ in range(100)]
    other = " ".join(f"v{i}" for i in range(40))
    edit = " ".join([*base[:50], "new", *base[51:]])
    rows = [(5, " ".join(base)), (3, edit), (3, other), (None, edit.upper()), (8, other), (8, other), (7, None), (6, ""), (None, None), (None, "lone words here"), (2, "lone"), (2, "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = near.without_near_copies(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id or 0, r.text) for r in got.collect()), key=str) == sorted([(3, edit), (3, other), (6, ""), (0, "lone words here"), (2, "lone")], key=str)
    assert near.without_near_copies(df.limit(0)).count() == 0


def test_a_crowd_of_near_copies_is_linked_like_by_brute_force(spark):
    """One crowd of alike texts and a phrase in all: buckets are large, take rounds, and bitmaps must not lose a pair."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(90)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join([*"the very same old phrase".split(), *words])))
    rows += [(1000 + i, "the very same old phrase " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 30)))) for i in range(60)]
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [t.split()]}
    root = {i: i for i in grams}
    for a in grams:
        for b in grams:
            if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if r == old else r for k, r in root.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for centres in (near.CENTRES, 3):
        assert {r.doc_id: r.component_id for r in near.near_components(df, centres=centres).collect()} == root


# -- the pipeline -------------------------------------------------------------------------------------------------------
def test_every_stage_of_the_pipeline_and_its_run(spark, tmp_path):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    more = docs.unionByName(extra).unionByName(docs.where("doc_id < 5")).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(10**9)))
    rows = [(r.doc_id, r.text) for r in more.collect()]
    (tmp_path / "sf").mkdir()
    more.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "sf" / "labels.parquet"))
    x, at = more, {}
    for name, step in c.STAGES:
        x = step(spark, x, str(tmp_path / "sf")).cache()
        at[name] = x.collect()
        assert name == "bpe" or x.columns == more.columns
    rejected = {r.doc_id for r in toxicity.score(more, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    gone = {t for i, t in rows if i in rejected}
    assert sorted(((r.doc_id, r.text) for r in at["toxicity"]), key=str) == sorted(((i, t) for i, t in rows if t not in gone), key=str)
    norm = lambda t: (t or "").encode().lower()
    best = {}
    for r in at["toxicity"]:
        k = norm(r.text)
        best[k] = max(best.get(k, -1), -1 if r.doc_id is None else r.doc_id)
    assert {norm(r.text): -1 if r.doc_id is None else r.doc_id for r in at["exact_dedup"]} == best and len(at["exact_dedup"]) == len(best)
    grams = {r.doc_id: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for r in at["exact_dedup"] for w in [norm(r.text).split()]}
    root = {i: i for i in grams}
    for a in sorted(grams):
        for b in sorted(grams):
            if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if r == old else r for k, r in root.items()}
    assert {r.doc_id for r in at["simhash_near_dedup"]} == set(root.values())
    assert {r.doc_id for r in at["mixing"]} == set(root.values()) and len(at["bpe"]) == len(at["mixing"])
    assert sorted(r.ids_sha256 for r in c.run(spark, str(tmp_path / "sf")).collect()) == sorted(r.ids_sha256 for r in at["bpe"])


def _crowds():
    """Rows of crowds that hang together by edits, some across crowds, and the components by brute force."""
    rng = random.Random(21)
    rows = []
    for c in range(8):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for i in range(40):
            words = list(base)
            for _ in range(rng.randrange(1, 18)):
                words[rng.randrange(300)] = f"z{rng.randrange(10**6)}"
            rows.append((100 * c + i, " ".join(words)))
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    root = {i: i for i in grams}
    for a in grams:
        for b in grams:
            if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if r == old else r for k, r in root.items()}
    return rows, root


def test_near_copies_are_verified_without_sets_on_disk(spark):
    """what the operator writes to the shared folder are hashes and pairs, less than a text's size, however many pairs there are."""
    from pathlib import Path

    from tracewright import session

    rows, root = _crowds()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = Path(session._own_dir(spark).removeprefix("file://").removeprefix("file:"))
    before = set(folder.iterdir())
    assert {r.doc_id for r in near.without_near_copies(df).collect()} == set(root.values())
    left = [p for p in folder.iterdir() if p not in before]
    assert sum(f.stat().st_size for p in left for f in p.glob("*.parquet")) < sum(len(t) for _, t in rows) / 3


def test_near_copies_in_blocks_parts_and_with_many_roots(spark, monkeypatch):
    """groups cut into cells by their size or pairs, lists of texts done in parts, roots joined to pairs: all link the same."""
    rows, root = _crowds()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    linked = near._linked
    for together, most, pairs in ((3000, near.FEW, near.PAIRS), (near.TOGETHER, 40, 50)):
        monkeypatch.setattr(near, "PAIRS", pairs)
        monkeypatch.setattr(near, "_linked", lambda *a, t=together, m=most: linked(*a, t, m))
        assert {r.doc_id: r.component_id for r in near.near_components(df).collect()} == root


def test_batches_of_the_pipeline_are_bounded_in_bytes(spark):
    """10,000 texts of 2 kB came to a worker at once."""
    import corpus_pipeline as c
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    c.drop_copies(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), "")
    got = [r.n for r in spark.range(6000).coalesce(1).select(F.repeat(F.lit("x"), 2000).alias("text")).mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 12_000_000 and max(got) < 5_000_000


def test_counts_rule_out_long_texts_and_no_pair_that_is_alike():
    """parities of 3,000 shingles let all long texts through, whole, to be verified."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = {1: base, 2: np.r_[base[:2700], rng.integers(0, 2**63, 250).astype(np.uint64)], 3: rng.integers(0, 2**63, 3000).astype(np.uint64)}
    rows = [(7, None, i, len(s), near._counts(s).tobytes()) for i, s in sets.items()] + [(7, 1, 2, None, None), (7, 1, 3, None, None)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["block", "a", "b", "n", "cells"])
    assert [r for b in near._counted_apart(0.8)([batch]) for r in b.to_pylist()] == [{"a": 1, "b": 2}]


def test_near_copies_come_as_a_pair_once_from_all_large_buckets(spark):
    """a pair came from each of the hundred buckets in which it met, so rows grew with the square of a crowd, times its buckets."""
    nodes = [1000 + 7 * i for i in range(30)]
    lost = {(k, n) for k in range(40) for n in nodes if (k * 31 + n) % 11 == 0}  # near copies do not meet in all buckets
    rows = [(k, n, 200, pos) for n in nodes for pos, k in enumerate(k for k in range(40) if (k, n) not in lost)]
    df = near._after(spark.createDataFrame(rows, "key long, node long, n int, pos int"))
    assert {len(r.earlier) for r in df.collect()} == {near.EARLIER}
    df = df.select("key", "node", "n", "pos", F.col("node").alias("root"), "earlier", F.expr(f"array_repeat(cast(0 as long), {near._WORDS})").alias("bits"))
    schema = "a long, b long, key long, node long, n int, pos int, earlier array<long>"
    got = df.coalesce(1).sortWithinPartitions("key", "node").mapInArrow(near._pairs(100, 0.8), schema).where("a is not null").collect()
    assert sorted((min(r.a, r.b), max(r.a, r.b)) for r in got) == [(a, b) for a in nodes for b in nodes if a < b]


def test_words_that_a_worker_remembers_are_few_and_those_seen_again_stay():
    """the words of 8 million characters took 300 MB of each worker."""
    from tracewright.llm import bpe

    made = []
    known = bpe._Known(lambda w: made.append(w) or (len(w),))
    for i in range(400_000):
        assert known[f"word{i:06d}"] == (10,)
        assert known["often"] == (5,)
    assert sum(map(len, known)) + sum(map(len, known.older)) <= 2_100_000
    assert made.count("often") == 1
