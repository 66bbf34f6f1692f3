"""The corpus operators against brute force, and their edge cases."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("tracewright.llm")

from pyspark.sql import functions as F  # noqa: E402

from tracewright.llm import bpe, exact_dedup, language, mixing, pages, pii, simhash, substrings, toxicity, winnowing  # noqa: E402
from tracewright.llm.queries import vocabulary  # noqa: E402

EDGES = [
    (1, "Alpha beta gamma delta epsilon zeta " * 8, "en"),
    (2, "ALPHA beta gamma delta epsilon zeta " * 8, "en"),
    (3, "", None),
    (4, None, "fr"),
    (5, "wörter über straße " * 30, "de"),
    (5, "wörter über straße " * 30, "de"),
    (6, "x" * 30_000, None),
    (None, "lone row", "en"),
]
#: Names that the operators use inside.
EXTRA = ("digest", "norm", "chk", "fp", "key", "block", "kept", "th", "doc", "h", "held_out", "score", "rate", "copies", "row", "n_tokens", "p_0", "_rank", "domain")


@pytest.fixture(scope="module")
def edges(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1).cast("long"))
    return df.select("*", *[F.lit("clash").alias(c) for c in EXTRA])


def _labels(spark):
    return spark.createDataFrame([(1, 0, 0), (5, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda s, d: exact_dedup.exact_dedup(d),
    "op2": lambda s, d: winnowing.fingerprint_edits(d),
    "op3": lambda s, d: substrings.remove_repeats(d),
    "op5": lambda s, d: bpe.bpe_encode(d, vocabulary()),
    "op6": lambda s, d: pii.surrogates(d, "k"),
    "op7": lambda s, d: simhash.simhash_components(d),
    "op8": lambda s, d: toxicity.score(d, _labels(s)),
    "op9": lambda s, d: language.identify(d),
    "op10": lambda s, d: mixing.mix(d, d.select("doc_id", "text", F.col("lang").alias("domain"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_and_empty_tables(spark, edges, name):
    got = OPERATORS[name](spark, edges).collect()
    assert len(got) == len(EDGES) and sorted(r.doc_id or 0 for r in got) == sorted(i or 0 for i, _, _ in EDGES)
    same = [r for r in got if r.doc_id == 5]
    if name != "op2":  # of two equal rows one is the other's next document
        assert str(same[0]) == str(same[1])
    plain = OPERATORS[name](spark, edges.select("doc_id", "text", "lang"))  # other columns change nothing
    assert sorted(map(str, plain.collect())) == sorted(map(str, got))
    empty = {r.doc_id: r for r in got if r.doc_id in (3, 4)}  # a null text is an empty one
    for c in ("text_sha256", "fingerprint", "kept_sha256", "ids_sha256", "text", "score", "lang_pred", "n_tokens"):
        if c in got[0]:
            assert empty[3][c] == empty[4][c]
    assert OPERATORS[name](spark, edges.where("false")).count() == 0


def test_exact_dedup_brute_force(spark, edges):
    rng = random.Random(1)
    texts = ["One", "one", "ÉTÉ", "été", "two", ""]
    rows = [(i, rng.choice(texts)) for i in range(60)]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    norm = lambda t: t.encode().lower()
    for i, t in rows:
        same = [j for j, u in rows if norm(u) == norm(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(same), len(same), i == max(same), hashlib.sha256(norm(t)).hexdigest())


def test_binary_fuse_has_no_false_negative():
    keys = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    for n in (1, 2, 3, 10, 5000):
        f = exact_dedup.build_filter(keys[:n])
        assert exact_dedup.probe_filter(keys[:n], *f).all()
    assert exact_dedup.probe_filter(keys + np.uint64(1), *f).mean() < 0.02


def test_winnowing_edits_and_likeness(spark):
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(words) for _ in range(150))) for i in range(30)] + [(30, "same text"), (31, "same text")]
    got = {r.doc_id: r for r in winnowing.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids = sorted((i for i, _ in rows), reverse=True)
    text = dict(rows)
    for k, i in enumerate(ids):
        nxt, t = text[ids[(k + 1) % len(ids)]], text[i]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert all(got[i].near_edited > 0.25 > got[i].near_next for i in range(30))
    assert got[31].fingerprint == got[30].fingerprint and got[31].near_next == 1.0


def _removed(docs):
    seen, out = set(), {}
    for i, raw in sorted(docs.items()):
        cover = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                cover[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, m in zip(raw, cover, strict=True) if not m)
        runs = sum(1 for k in range(len(cover)) if cover[k] and (k == 0 or not cover[k - 1]))
        out[i] = (len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_substrings_brute_force(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    docs = {i: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(20, 500))) for i in range(30)}
    for i in range(0, 30, 3):
        a = rng.randrange(0, 120)
        docs[i] += passage[a : a + rng.randrange(90, 140)] + "é" + docs[(i + 1) % 30][:120]
    docs[40], docs[41], docs[42] = "a" * 400, "ab" * 200, passage * 2
    want = _removed({i: t.encode() for i, t in docs.items()})
    rows = spark.createDataFrame([*docs.items(), (42, docs[42]), (3, docs[3])], "doc_id long, text string")
    for crowded in (substrings.CROWDED, 1):  # with 1, strings are taken apart under every anchor
        got = substrings.remove_repeats(rows, crowded=crowded).collect()
        assert len(got) == len(docs) + 2
        assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got)


def test_deep_shallow_orders_like_a_plain_sort():
    raw = bytes(random.Random(5).choices(b"ab", k=500)) * 2
    starts = np.arange(len(raw) - 100)
    order, new = substrings.deep_shallow(np.frombuffer(raw, np.uint8), starts, shallow=16)
    strings = [raw[s : s + 100] for s in starts[order]]
    assert strings == sorted(strings) and list(new) == [True, *[a != b for a, b in zip(strings, strings[1:], strict=False)]]


def test_pages():
    page = (
        '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></ul></nav><div class="ad">Buy this now it is good.</div>'
        "<article><h1>Head &amp; line</h1><p>First&nbsp;paragraph <b>with</b> text.<p>One.<ul><li>item</ul><aside>Side note here</aside></article>"
        '<section id="comments"><p>I like this article very much, thank you for it.</section><footer>&copy; me</footer>'
    )
    assert pages.main_text(page) == "Head & line First paragraph with text. One. item"
    assert pages.main_text(None) == pages.main_text("") == "" and pages.main_text("<article><p>cut off <b>he") == "cut off he"


def test_bpe_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    own = bpe.WordBpe(open(vocabulary(), encoding="utf-8").read())
    rng = random.Random(6)
    pool = "abcdeinorst ABC  \t\n\x1c\x85　'sErÉßİΣςσ12³½漢字😀́!!..,</w>\x00"
    texts = ["", "<|endoftext|> a<|startoftext|>", "a" * 3000, *("".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(400))]
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        assert own.encode(x) == ids
        assert own.decode(np.array(ids, np.int64)).decode() == t.decode(ids, skip_special_tokens=False)


def test_pii_is_consistent_distinct_and_format_true(spark):
    text = "Call +1 (643) 555-5742 or mail Ann.Lee7@mail.example.com; Mrs Anna Schmidt paid 4111 1111 1111 1111 from 10.20.30.40. token = \"73d74656391396c3efc1d06034ff67f1\""
    rows = [(1, text), (2, "again +1 (643) 555-5742, ann.lee7@mail.example.com and Mrs Anna Schmidt"), (3, "nothing private here")]
    got = {r.doc_id: r for r in pii.surrogates(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for secret in ("555-5742", "Ann.Lee7", "Schmidt", "4111 1111", "10.20.30.40", "73d74656"):
        assert secret not in got[1].text
    assert got[1].n_entities == 6 and got[3].text == rows[2][1] and got[3].n_entities == 0
    phone = got[1].text.split("Call ")[1][:17]
    assert phone in got[2].text and phone.startswith("+1 (") and len(got[1].text.split("paid ")[1].split(" from")[0]) == 19
    assert len({pii.replace(b"k" * 32, "ssn", f"{i:09d}") for i in range(2000)}) == 2000


def test_simhash_brute_force(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = list(base[(i % 6) * 5 : (i % 6) * 5 + 30])
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    rows += [(200, ""), (201, None), (202, "Hi"), (203, "hi")]
    fp = {i: simhash.fingerprint(t) for i, t in rows}
    parent = {i: i for i in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fp)
    for a in ids:
        for b in ids:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()}
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i in ids}
    distinct = df.select(F.lit(1)).limit(0)  # the deep tables find the same links as the direct ones
    distinct = spark.createDataFrame([(simhash._signed(x),) for x in set(fp.values())], "fp long")
    from tracewright.operators.components import contract

    roots = [contract(simhash.links(distinct, direct=d)).groupBy("root").agg(F.sort_array(F.collect_set("node")).alias("n")).select("n").collect() for d in (2, 1024)]
    assert sorted(map(str, roots[0])) == sorted(map(str, roots[1]))


def test_covering_masks_cover_every_triple():
    rng = random.Random(8)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not diff & m for m in simhash.MASKS)


def test_toxicity_learns_terms_misspellings_and_quotes():
    rng = random.Random(9)
    filler = [f"{a}{b}{c}" for a in ("ba", "ke", "ti", "lo") for b in ("ra", "no", "mi") for c in ("st", "ll", "nd")]
    text = lambda *extra: " ".join(rng.sample([*rng.choices(filler, k=40), *extra], 40 + len(extra)))
    rows = [(1, text("dumbhead", "vequ" + rng.choice(filler))) for _ in range(80)] + [(0, text()) for _ in range(160)]
    lexicon, w = toxicity.learn(rows)
    p = lambda t: float(1 / (1 + np.exp(-(toxicity._inputs(np.array([lexicon.features(t)])) @ np.array(w))[0])))
    assert p("you are a dumbhead") >= 0.7 > 0.3 > p("a kind word") and p("you dumbhaed dunbhead") > p("a kind word")
    assert p('he said "dumbhead" in a quote') < p("you dumbhead")
    assert lexicon.read("dumbhead") == toxicity.EXACT and lexicon.read("dumbhea") in (toxicity.FUZZY, toxicity.STEM)


def test_language_mixture():
    rows = [("aa", "kami kato mika toki " * 30), ("bb", "zweln brund stolm grelb " * 30)]
    m = language.Mixture.fit(rows)
    s = m.words("kami toki mika kato kami zweln")
    share = m.infer(s, np.zeros(len(s), int), 1)[0]
    assert m.langs[share.argmax()] == "aa" and abs(share.sum() - 1) < 1e-9


def test_mixing_meets_targets(spark):
    rows = [(i, ("kami kato " if i % 4 else "zweln brund ") * 20, "aa" if i % 4 else "bb") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = mixing.mix(d, d.select("doc_id", "text", F.col("lang").alias("domain")), weights={"aa": 0.5, "bb": 0.5})
    by = {r.domain: r.t for r in got.groupBy("domain").agg(F.sum(F.col("rate") * F.col("n_tokens")).alias("t")).collect()}
    assert abs(by["aa"] / by["bb"] - 1) < 0.01 and got.where("rate < 0").count() == 0


def test_pipeline_drops_and_keeps(spark, edges):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "bpe"]
    kept = c.drop_copies(spark, edges, "")
    assert kept.columns == edges.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 4, 5, 6]
    near = c.drop_near_copies(spark, edges, "")
    assert sorted(r.doc_id or 0 for r in near.collect()) == [0, 1, 3, 5, 6]
    mixed = c.mix_domains(spark, edges, "")
    assert mixed.columns == edges.columns and {r.doc_id for r in mixed.collect()} == {r[0] for r in EDGES}


def test_near_copies_of_the_pipeline_are_all_pairs_of_similarity(spark):
    import corpus_pipeline as c
    from tracewright.llm import near

    rng = random.Random(11)
    base = [[f"w{rng.randrange(900)}" for _ in range(120)] for _ in range(8)]
    rows = []
    for i in range(160):
        words = list(base[i % 8])
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(500)}"
        rows.append((i, " ".join(words)))
    rows += [(200, ""), (201, None), (202, "Hi you"), (203, "hi you"), (204, "hi")]
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [(t or "").lower().split()]}
    root = {i: i for i in grams}
    for a in grams:
        for b in grams:
            if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if r == old else r for k, r in root.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for centres in (near.CENTRES, 10):  # with 10, buckets take several rounds
        assert {r.doc_id: r.component_id for r in near.near_components(df, centres=centres).collect()} == root
    assert {r.doc_id for r in c.drop_near_copies(spark, df, "").collect()} == set(root.values())


def test_pii_replacements_are_distinct_beyond_the_pool(spark):
    names = [f"X{a}{b}{c}" for a in "abcdefgh" for b in "aeiouyrs" for c in "klmnprst"][:500]
    df = spark.createDataFrame([(i, f"said Mr {n} and password = 密码密码密码") for i, n in enumerate(names)], "doc_id long, text string")
    got = [r.text.split("Mr ")[1].split(" and")[0] for r in pii.surrogates(df, "k").collect()]
    assert len(set(got)) == len(names) and not set(got) & set(names)
    with pytest.raises(RuntimeError):
        pii.moved_entities(df, b"k" * 32, rounds=1)
