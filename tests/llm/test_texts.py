import random

import numpy as np
import pytest

from celltrack.llm import leaks, mixing, truncation

WORDS = "harbour quarry lantern meadow winter signal barley copper tunnel violet ember granite pepper orchard saddle timber walnut ribbon candle feather marble pillow thunder velvet anchor basket garden island jacket kettle ladder magnet needle oyster pencil rabbit silver tomato umbrella window yellow zipper bridge castle dragon engine forest guitar hammer insect jungle".split()


def passage(rng, n):
    return [rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n)]


def letters_of(texts):
    letters, begin, starts = leaks.streams(texts)
    end = [*(begin[1:] - leaks.DEPTH), len(letters) - 2 * leaks.DEPTH]
    return [letters[b:e].tobytes().decode() for b, e in zip(begin, end)], [(starts[(starts >= b) & (starts < e)] - b).tolist() for b, e in zip(begin, end)]


def test_streams_even_out_spelling():
    want = letters_of(["the naive cafe was closed"])[0][0]
    odd = ["The naïve café, was CLOSED!", "the na-\nive ca fe was cl0sed", "the na&iuml;ve caf&eacute; was closed", "the naÃ¯ve cafÃ© was closed", "the nаive cafе wаs clоsed", "the na\\u00efve café was clo­sed"]
    for t in odd:
        assert letters_of([t])[0][0] == want, t
    assert letters_of(odd)[0] == [want] * len(odd)


def test_streams_of_a_shard_equal_those_of_each_text():
    texts = ["", "A b", "c0st 10 l0 x", "\x02 a\x02b", "ß&amp;ﬁne e\u0301t\u00e9 \\u0002x", "", "no" * 30 + " yes", "…", "\ud800 z", ""]
    words, starts = letters_of(texts)
    for t, w, s in zip(texts, words, starts):
        plain = leaks.even(t.replace("\x02", " "))
        assert w == "".join(c for c in plain if c.isalnum()), t
        assert (w, s) == tuple(x[0] for x in letters_of([t]))
    assert starts[1] == [0, 1] and starts[6] == list(range(61)), starts


def test_leaks_through_damage(spark):
    rng = random.Random(4)
    items, docs, want = [], [], set()
    for i in range(12):
        w = passage(rng, 45)
        items.append((i, " ".join(w)))
        part = w[5:25]
        pre, post = " ".join(passage(rng, 30)), " ".join(passage(rng, 30))
        typo = [x if k % 5 else x[:2] + "q" + x[3:] for k, x in enumerate(part)]
        variants = [
            " ".join(part).upper(), ", ".join(part), " ".join(typo), " ".join(part[:9]) + " [Interruption.] I must protest, said the member. " + " ".join(part[9:]),
            "".join(x + ("\n" if k % 3 else "-\n" if k % 2 else " ") for k, x in enumerate(part)), "".join(part),
        ]
        for k, v in enumerate(variants):
            docs.append((100 * i + k, f"{pre} {v} {post}"))
            want.add((i, 100 * i + k))
        docs += [(100 * i + 50, f"{pre} {' '.join(part[:17])} {post}"), (100 * i + 51, f"{pre} {' '.join(part[:10])} {post} {' '.join(part[10:0:-1])}"), (100 * i + 52, " ".join(reversed(w)))]
    docs += [(9000, None), (9001, ""), (None, items[0][1]), (9002, "word " * 3), (9003, "pad " * 400_000 + items[3][1]), (9003, "pad " * 400_000 + items[3][1])]
    want.add((3, 9003))
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS n_words")
    it = spark.createDataFrame(items + [(None, "x"), (77, None), (78, "")], "item_id bigint, text string")
    got = {(r.item_id, r.doc_id) for r in leaks.find_leaks(d, it).collect()}
    assert got == want
    assert {(r.item_id, r.doc_id) for r in leaks.find_leaks(d, it, item_bytes=1500).collect()} == want  # in several blocks
    assert leaks.find_leaks(d.limit(0), it).count() == 0 and leaks.find_leaks(d, it.limit(0)).count() == 0
    assert leaks.without_leaks(d.filter("doc_id < 9000"), leaks.find_leaks(d, it)).count() == 36


def test_suffix_search_equals_brute_force():
    rng = random.Random(9)
    docs = [" ".join("".join(rng.choice("ab") for _ in range(3)) for _ in range(70)) for _ in range(5)]
    letters, begin, starts = leaks.streams(docs)
    shard = leaks.SuffixShard(letters, starts)
    asked = ["".join(rng.choice("ab") for _ in range(leaks.SEED)) for _ in range(60)]
    keys = leaks.word_keys(np.frombuffer("".join(a + "\0" * leaks.DEPTH for a in asked).encode(), np.uint8), np.arange(len(asked)) * (leaks.SEED + leaks.DEPTH))
    lo, hi = shard.find(keys)
    got = {(k, int(p)) for k in range(len(asked)) for p in shard.place[lo[k] : hi[k]]}
    plain = [d.replace(" ", "") for d in docs]
    want = {(k, int(begin[d]) + s) for k, a in enumerate(asked) for d, t in enumerate(plain) for s in range(0, len(t), 3) if t.startswith(a, s)}
    assert got == want and want


def test_longest_match_and_its_place(spark):
    rng = random.Random(12)
    w, pre = passage(rng, 40), passage(rng, 25)
    broken = w[3:30]
    broken[11] = broken[11][:2] + "q" + broken[11][3:]  # 26 whole words around one slip
    d = spark.createDataFrame([(1, " ".join(pre + broken)), (2, " ".join(pre + w[3:15] + pre))], "doc_id bigint, text string")
    (r,) = leaks.find_leaks(d, spark.createDataFrame([(5, " ".join(w))], "item_id bigint, text string")).collect()
    tail = broken[11][3:] + "".join(broken[12:])
    assert (r.item_id, r.doc_id, r.n_words, r.first_word) == (5, 1, 27, 3)
    assert r.longest == len(tail) and r.place == len("".join(pre + broken)) - len(tail)


@pytest.mark.parametrize("every, least", [(0, 1.0), (6, 0.95), (4, 0.9), (3, 0.9)])
def test_recall_under_typing_damage(every, least):
    """Runs of 18 words, every n-th of them with one letter changed, left out, put in or swapped, but for the outermost."""
    rng = random.Random(every)
    items = leaks.Items([(i, " ".join(passage(rng, 40))) for i in range(10)])
    text = [[t[a:b] for a, b in zip(e[:-1], e[1:])] for t, e in zip(items.text, items.ends)]
    docs, want = [], []
    for _ in range(100):
        i, a = rng.randrange(10), rng.randrange(20)
        run = list(text[i][a : a + 18])
        for k in range(1, 17):
            if every and k % every == 0:
                w, at, c = run[k], rng.randrange(1, len(run[k]) - 1), rng.choice("abcdefghijklmnopqrstuvwxyz")
                run[k] = rng.choice([w[:at] + c + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + w[at + 1] + w[at] + w[at + 2 :]])
        docs.append(" ".join(passage(rng, 20) + run + passage(rng, 20)))
        want.append(i)
    found = {(r[1], r[0]) for r in leaks._search(items, list(range(100)), docs)}
    assert len(found & set(enumerate(want))) >= 100 * least and len(found - set(enumerate(want))) == 0


@pytest.mark.parametrize(
    "text, form",
    [("He said so.", "sentence"), ("and so&nb", "code"), ("and so\\u00", "code"), ("he said (Laugh", "bracket"), ("it ends.\n— J. Smith, Ostrey", "signature"), ("I was going to—", "dash"), ("we will not sup", "word"), ("Fish & chips", "word"), ("“Never!”", "sentence")],
)
def test_forms(text, form):
    assert truncation.form_of_end(text) == form


@pytest.mark.parametrize(
    "text, form",
    [("It ends.\n\n– Z", "word"), ("It ends.\n– Une voix : Tr", "word"), ("It ends.\n– Une voix : Très bien !", "sentence"), ("It ends.\n– Zwischenruf –", "dash"), ("It ends.\n— J. Sm", "word"), ("It ends.\n— O. Tessüber, the Carrow Isles", "signature")],
)
def test_forms_of_lines_that_begin_with_a_dash(text, form):
    assert truncation.form_of_end(text) == form


def test_cut_interjections_are_found(spark):
    rng = random.Random(4)
    end = {0: "– Zwischenruf –", 1: "– Une voix : Très bien !", 2: "— J. {}, {}"}
    docs = []
    for i in range(300):
        last = end[i % 3].format(rng.choice(WORDS).title() + str(i), rng.choice(WORDS).title() + "x" * (i % 7))
        docs.append((i, "de", "x", f"The {rng.choice(WORDS)} was sold before the {rng.choice(WORDS)} arrived.\n\n{last}"))
    for k, cut_line in enumerate(("– Z", "– Zwischenruf", "– Une", "– Une voix : Tr")):
        docs.append((1000 + k, "de", "x", f"The {rng.choice(WORDS)} was lost.\n\n{cut_line}"))
    d = spark.createDataFrame(docs, "doc_id bigint, lang string, source string, text string")
    assert {r.doc_id for r in truncation.scored_ends(d).filter("truncated").collect()} == {1000, 1001, 1002, 1003}


def test_marks_of_omission_come_off():
    for t in ("we will…", "we will ...", "we will [...]", "we will [more]", "we will (cont."):
        assert truncation.strip_omission(t) == "we will", t
    assert truncation.strip_omission("leave out subsection (3)") == "leave out subsection (3)"


def test_cut_texts_are_found(spark):
    rng = random.Random(2)
    say = lambda: f"The {rng.choice(WORDS)} near the {rng.choice(WORDS)} was {rng.choice(['sold', 'lost', 'mended'])} before the {rng.choice(WORDS)} arrived."
    docs, cut_ids = [], set()
    for i in range(900):
        t = " ".join(say() for _ in range(6))
        if i % 9 == 1:
            t += f"\nClause {rng.randint(1, 99)} ordered to stand"
        elif i % 9 == 2:
            t += " The " + rng.choice(WORDS) + " was—"
        elif i % 30 == 3:
            at = len(t) - rng.randint(12, 40)
            if t[at - 1] not in " ." and t[at] not in " .":
                t = t[:at] + rng.choice(["", "…", " [...]"])
                cut_ids.add(i)
        docs.append((i, "en" if i % 2 else " EN", "Paper_A" if i % 3 else "paper a", t))
    docs += [(5000, None, None, None), (5001, "en", "x", ""), (5002, "en", "x", "   "), (None, "en", "x", "The lan"), docs[5]]
    d = spark.createDataFrame(docs, "doc_id bigint, lang string, source string, text string").selectExpr("*", "1 AS id", "2 AS form")
    out = truncation.scored_ends(d)
    assert {r.doc_id for r in out.filter("truncated").collect()} == cut_ids
    assert out.count() == len(docs) - 1
    rates = {r.source: r for r in truncation.truncation_rates(d).filter("language = 'en'").collect()}
    assert set(rates) == {"paper_a", "x"} and rates["paper_a"].n_truncated == len(cut_ids)
    assert truncation.scored_ends(d.limit(0)).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 900, 500)
    p = np.full(500, 0.37)
    q = mixing.flight(p, size)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())
    assert set(mixing.land(q, size)) <= {0.0, 1.0}
    assert mixing.flight(np.zeros(0), np.zeros(0, int)).shape == (0,)


def test_inclusion_is_fair():
    size = np.array([5, 9, 14, 3, 8, 11, 6, 7])
    seen = np.mean([mixing.land(mixing.flight(np.full(8, 0.5), size, k), size) for k in range(400)], axis=0)
    assert 0.2 < seen.min() and seen.max() < 0.8


def test_mix_reaches_its_shares(spark):
    rng = random.Random(5)
    docs = [(i, ["Alpha", "beta ", "BETA", "gamma"][i % 4] if i % 11 else None, " ".join(passage(rng, rng.randint(5, 60)))) for i in range(1500)]
    docs += [(9000, "alpha", None), (9001, "alpha", ""), (None, "alpha", "text"), docs[3]]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string").selectExpr("*", "1 AS p", "2 AS copies")
    t = spark.createDataFrame([("alpha", 1.0, 2), ("beta", 2.0, 1), ("gamma", 3.0, 3), ("delta", 1.0, 4), ("gone", -1.0, 2), ("null", None, None)], "source string, weight double, max_repeats int")
    m = mixing.mix(d, t).toPandas()
    cap = {"alpha": 2, "beta": 1, "gamma": 3}
    assert set(m.source) == set(cap) and all(m.copies <= m.source.map(cap)) and m.doc_id.is_unique
    s = {r.source: r for r in mixing.mix_shares(d, t).collect()}
    assert [s[k].share for k in cap] == pytest.approx([1 / 6, 2 / 6, 3 / 6], abs=0.003)
    assert s["delta"].share == 0 and "gone" not in s
    assert m.sort_values("doc_id").equals(mixing.mix(d, t).toPandas().sort_values("doc_id")) or sorted(zip(m.doc_id, m.copies)) == sorted((r.doc_id, r.copies) for r in mixing.mix(d, t).collect())
    assert mixing.mix(d.limit(0), t).count() == 0 and mixing.mix(d, t.limit(0)).count() == 0


def test_a_run_with_one_undamaged_stretch_is_found(spark):
    words = "bargain chimney dolphin elegant fashion gallery harvest imagine journey kitchen lantern mineral nothing orchard pasture quarter railway sandbox tobacco uniform".split()
    slip = lambda w: w[:3] + ("x" if w[3] != "x" else "k") + w[4:]
    damaged = [w if k in (9, 10, 11) else slip(w) for k, w in enumerate(words)]
    text, ends = leaks.item_words(" ".join(words))
    whole = "and" + "".join(damaged) + "then"
    assert sum(text[p : p + leaks.SEED] in whole for p in ends[:-1] if len(text) - p >= leaks.SEED) < 4
    items = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    # an earlier place repeats the undamaged words alone
    docs = spark.createDataFrame([(5, "and " + " ".join(damaged) + " then"), (6, " ".join(words[8:13]) + " and so on. Later: " + " ".join(damaged)), (7, " ".join(words[:17]))], "doc_id bigint, text string")
    assert {(r.item_id, r.doc_id) for r in leaks.find_leaks(docs, items).collect()} == {(1, 5), (1, 6)}


def test_folding_a_batch_equals_folding_each_text():
    texts = ["", "A  12\n\t3b", "٣٤ x\u3000 y", "ΑΣ. ΑΣ", "x" * 30, "  0", "9", "İ²"]
    codes, inside = truncation.folded(texts)
    assert "".join(map(chr, codes.tolist())) == truncation.BREAK.join(truncation.fold(t) for t in texts)
    assert inside.tolist() == [k for t in texts for k in range(len(truncation.fold(t)) + 1)][:-1]


def test_context_hashes_depend_on_the_context_alone():
    rng = random.Random(5)
    texts = [" ".join(passage(rng, 6)) for _ in range(20)]
    codes, inside = truncation.folded(texts)
    ctx = truncation.Contexts(codes)
    for n in truncation.ORDERS:
        at = np.flatnonzero((inside >= n - 1) & (codes != 2))
        seen = {}
        for i, h in zip(at.tolist(), ctx.hashes(n, at).tolist()):
            assert seen.setdefault(codes[i - n + 1 : i + 1].tobytes(), h) == h
        assert len(set(seen.values())) == len(seen)


def test_counts_equal_brute_force_in_small_pieces(spark, monkeypatch):
    """n_all of every context, with long texts in pieces and counts given out early."""
    rng = random.Random(6)
    texts = [" ".join(passage(rng, rng.randint(1, 60))) + rng.choice([".", "", " 12", "!"]) for _ in range(60)] + ["", "a", " ".join(passage(rng, 4000)) + "."]
    d = spark.createDataFrame([(i, "en", "x", t) for i, t in enumerate(texts)], "doc_id bigint, lang string, source string, text string").repartition(3)
    base = {(r.doc_id, r.form, r.log_odds, r.truncated) for r in truncation.scored_ends(d).collect()}
    monkeypatch.setattr(truncation, "CHARS_AT_ONCE", 700)
    monkeypatch.setattr(truncation, "HELD_AT_ONCE", 50)
    monkeypatch.setattr(truncation, "LEAST_BITS", 1 << 16)
    assert {(r.doc_id, r.form, r.log_odds, r.truncated) for r in truncation.scored_ends(d).collect()} == base


def test_differing_rows_of_a_document_count_once_and_alike(spark):
    docs = spark.createDataFrame([(1, "b", "one two three"), (1, "a", "one two three four"), (1, "a", "one"), (2, None, None), (None, "a", "x")], "doc_id bigint, source string, text string")
    first = mixing.token_counts(docs.repartition(5)).collect()
    assert {(r.doc_id, r.source) for r in first} == {(1, "a"), (2, "(none)")} and {r.doc_id: r.n_tokens for r in first} == {1: 1, 2: 0}


def test_thresholds_by_language(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, "en" if i % 2 else "de", "x", " ".join(passage(rng, 8)) + (" the end" if i % 3 else " of")) for i in range(60)], "doc_id bigint, lang string, source string, text string")
    every = truncation.scored_ends(docs, thresholds={"de": 99.0}).collect()
    assert all(r.truncated for r in every if r.language == "de") and {r.truncated for r in every if r.language == "en"} != {True}
