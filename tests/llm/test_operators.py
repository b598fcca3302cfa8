import itertools
import os
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from refmill.llm import copies, labelmodel, linkage, lookalike, mixing, names, overlap, subjects, text, tokens, truncation


def test_standins_and_skeletons():
    assert text.standins("Selνowick") and text.standins("a b") and text.standins("ét") and text.standins("ﬂags")
    for own in ("α-pollinator decline", "Новый расчёт", "Müller – “quoted”", "plain\ttext\n", "В ПЕЛДАНАРИ"):
        assert not text.standins(own), own
    assert text.skeleton("Ｐｅｅｒ") == "Peer" and text.skeleton("pay​pal") == text.skeleton("рaypal")
    assert text.plain("ЦИФРОВОЙ") == text.plain("цифровой")


def test_lookalike_operator(spark):
    df = spark.createDataFrame([(1, "pаy", 0), (2, "pay", 0), (3, None, 0), (4, "", 0), (5, "pay", 0)], "id long, t string, record_id int")
    rows = lookalike.skeletons(df, "x", "id", "t")
    assert [r.record_id for r in lookalike.with_standins(rows).collect()] == [1]
    assert [(r.n_rows, r.n_texts, r.first_id) for r in lookalike.lookalike_groups(rows).collect()] == [(3, 2, 1)]
    assert lookalike.skeletons(df.limit(0), "x", "id", "t").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_chunks_join_to_the_whole(spark, seed):
    r = random.Random(seed)
    texts = ["".join(r.choice(["word ", "Ünï", "  ", "\n", "don't", "123", "市场", "🙂", "x" * 50]) for _ in range(n)) for n in (0, 5, 3000, 6000)] + ["a" * 9000, " " * 9000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    enc = tokens.encoder("/opt/tokenizers/byte_bpe_50k.tiktoken")
    got = {r.id: list(r.ids) for r in tokens.encode_texts(df, "id", "t", chunk=512).collect()}
    spread = {r.id: list(r.ids) for r in tokens.encode_texts(df, "id", "t", chunk=512, spread=4096).collect()}
    assert got == spread and got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert all(enc.decode(got[i]) == (t or "") for i, t in enumerate(texts))


def test_same_fields():
    a = "Smith, J. (2020). A long title here. Journal of Things, 10(49), 1-9."
    assert copies.same_fields(a, "1–9 | JOURNAL OF THINGS | Smith, J | 2020 | 10(49) | A long ti tle here.")
    assert not copies.same_fields(a, "Smith, J. (2020). A long title here. Journal of Things, 49(10), 1-9.")
    assert not copies.same_fields("Water and Forest policy. Press, 2020.", "Forest and Water policy. Press, 2020.")
    many = [f"field{k} of many words" for k in range(300)]
    assert copies.same_fields("; ".join(many), " | ".join(reversed(many))) and not copies.same_fields("; ".join(many), "; ".join([*many[1:], many[0][::-1]]))
    assert copies.same_fields("aa1; " * 60 + "bb2", "bb2; " + "aa1; " * 60)
    assert not copies.same_fields(a, "Smith, J. (2020). A long tilte here. Journal of Things, 10(49), 1-9.")


def test_copies_operator(spark):
    rows = [(3, "A b, c 2020"), (1, "a B; C-2020"), (2, "2020 / a b, c"), (4, None), (5, ""), (6, "..."), (7, "other text 1"), (8, "other text 1")]
    got = copies.copies(*copies.collapse({"t": (spark.createDataFrame(rows, "id long, x string"), "id", "x")}))
    assert sorted((r.first_id, r.copy_id) for r in got.collect()) == [(1, 2), (1, 3), (7, 8)]
    empty = spark.createDataFrame([], "id long, x string")
    assert copies.copies(*copies.collapse({"t": (empty, "id", "x")})).count() == 0


def test_overlap_against_all_pairs(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(400)]
    base = [" ".join(r.sample(words, 14)) for _ in range(30)]
    rows = [(i, b if r.random() < 0.3 else b.replace(b.split()[4], "changed"), r.choice(["train", " Test ", "DEV", None])) for i, b in enumerate(base * 4)]
    got = {(x.first_row_id, x.second_row_id) for x in overlap.cross_split_pairs(spark.createDataFrame(rows, "row_id long, c string, s string"), "row_id", "c", "s").collect()}
    clean = [(i, overlap.core(c), s.strip().lower() == "train") for i, c, s in rows if s]
    want = {(min(i, j), max(i, j)) for i, a, x in clean for j, b, y in clean if x and not y and overlap.same_reference(a, b)}
    assert got == want and want


def test_truncation(spark):
    whole = [(i, "s", f"The quiet study of lakes and rivers in region{i % 7}. Journal of Water.") for i in range(60)]
    cutoff = [(100, "s", "The quiet study of lakes and"), (101, "s", "The quiet study of lakes and riv"), (102, "s", "The quiet study of lakes..."), (103, "s", ""), (104, "s", None)]
    got = {r.id: r.reason for r in truncation.truncated(spark.createDataFrame(whole + cutoff, "id long, src string, t string"), "id", "src", ["t"]).collect()}
    assert got[100] == "goes_on" and got[101] == "part_of_word" and got[102] == "mark" and 103 not in got and 104 not in got
    assert not any(got[i] for i in range(60))


def test_names(spark):
    people = [(1, "person", "Olslamavonis, Leonardo D."), (2, "person", "Olslamavonis, Susanna"), (3, "venue", "Annals of Northern Court Evidence"), (4, "organisation", "Ministry of Soil Quality, Tursiwick"), (9, "person", None), (10, None, "")]
    people += [(20 + i, "person", f"{s}, Leonardo") for i, s in enumerate(("Brandovik", "Kestrelin", "Morvander"))]
    authority = spark.createDataFrame(people, "entity_id long, entity_kind string, preferred_name string")
    authors = ["L. Olslamavonis", "Olslamavonis LD", "Leonardo Olslamavonsi", "Olslamavonis, R.", "Tursiwick, Ministry of Soil Quality", "", None, "Olslamavonis, Leo", "Lindavik, Leonardo", "Brandovik, Leo", "Leo Kestrelin", "Morvander Leo"]
    venues = ["Ann. North. Court Evid.", "ANCE", "Northern Court Evidence, Annals of", "Annals of Southern Court Evidence"]
    rows = [("x", i, "authors", 1, n) for i, n in enumerate(authors)] + [("x", 100 + i, "venue", 1, n) for i, n in enumerate(venues)] + [("x", 200, "authors", 1, "L. Olslamavonis")]
    mentions = spark.createDataFrame(rows, "record_kind string, record_id long, field_name string, pos int, name string")
    got = {r.record_id: r.entity_id for r in names.link_names(mentions, authority).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 4: 4, 7: 1, 9: 20, 10: 21, 11: 22, 100: 3, 101: 3, 102: 3, 200: 1}
    assert names.link_names(mentions.limit(0), authority).count() == 0 and names.link_names(mentions, authority.limit(0)).count() == 0


def test_names_meet_every_entity_they_may_stand_for(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abco") for _ in range(r.randint(1, 12)))
    for _ in range(3000):
        x = word()
        w = list(x[: r.choice((len(x), r.randint(1, len(x))))])
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(w))
            w[i : i + 1] = r.choice(([], [w[i], r.choice("abco")], [r.choice("abco")])) if r.random() < 0.7 else w[i : i + 2][::-1]
            w = w or ["a"]
        if r.random() < 0.3 and len(x) > 2:
            w = [x[0], *(c for c in x[1:-1] if r.random() < 0.5), x[-1]]
        w = "".join(w)
        for kind, fits in (("p", names.near), ("t", names._word_fits)):
            assert not fits(w, x) or names.name_keys(kind, w) & names.entity_keys(kind, x), (kind, w, x)
    # a title of one word with a slip; a person whose rarest n-grams are those of a slip's surname, in a crowd of their own kind
    people = [(1, "venue", "Glaciology"), (2, "person", "Morvandelik, Ann")] + [(10 + i, "person", f"{p}vandelik, Zoe") for i, p in enumerate(("Bor", "Cor", "Dor"))] + [(20, "person", "Xormand, Bo"), (21, "person", "Zuvxnde, Bo"), (22, "person", "Qaelxik, Bo")]
    authority = spark.createDataFrame(people, "entity_id long, entity_kind string, preferred_name string")
    rows = [("x", 1, "venue", 1, "Glaciolgy"), ("x", 2, "authors", 1, "Ann Morvxndelxik"), ("x", 3, "authors", 1, "Morvandelik, A.")]
    mentions = spark.createDataFrame(rows, "record_kind string, record_id long, field_name string, pos int, name string")
    assert {r.record_id: r.entity_id for r in names.link_names(mentions, authority).collect()} == {1: 1, 2: 2, 3: 2}


def test_names_send_no_table_by_way_of_the_driver(spark, monkeypatch):
    authority = spark.createDataFrame([(1, "person", "Olslamavonis, Leonardo D.")], "entity_id long, entity_kind string, preferred_name string")
    mentions = spark.createDataFrame([("x", 1, "authors", 1, "L. Olslamavonis")], "record_kind string, record_id long, field_name string, pos int, name string")
    plans = []
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(names, "cut", lambda df, real=names.cut: plans.append(plan(df)) or real(df))
    result = names.link_names(mentions, authority)
    assert [r.entity_id for r in result.collect()] == [1] and not any("BroadcastHashJoin" in p for p in [*plans, plan(result)])


def test_label_model_finds_the_accurate_voters():
    r = np.random.default_rng(0)
    truth = r.random(4000) < 0.3
    v = np.stack([np.where(r.random(4000) < a, np.where(truth, 1, -1), np.where(truth, -1, 1)) for a in (0.95, 0.9, 0.85, 0.6)], 1)
    guess = np.stack([v.sum(1) <= 0, v.sum(1) > 0], 1)
    post = labelmodel.fit_posteriors(v, np.ones(4000), guess)
    assert ((post > 0.5) == truth).mean() > 0.93
    # what the votes are worth is learned: a poor voter against three good ones changes little, a good one much
    assert len(labelmodel.fit_posteriors(np.zeros((0, 4)), np.zeros(0), np.zeros((0, 2)))) == 0


def test_linkage(spark):
    schema = "id long, title string, raw string, authors array<string>, year int, doi string, venue string"
    c = [(1, "Quiet lakes under heavy snowfall in Gimvorim", None, ["Lee, Ann"], 2020, "", "J. Lakes"), (2, None, None, None, None, None, None), (3, "Correction to: Quiet lakes under heavy snowfall in Gimvorim", "", ["Lee, A."], 2021, "", "")]
    p = [(11, "QUIET LAKES UNDER HEAVY SNOWFALL IN GIMVORIM", None, ["Ann Lee"], 2020, "", ""), (12, "Quiet lakes under heavy snowfall in Gimvorim", None, ["Zed Other"], 1990, "", ""), (13, "", None, [], None, "", "")]
    side = lambda rows, k, raw: linkage.records(spark.createDataFrame(rows, schema), k, "id", "title", raw, "authors", "year", "doi", "venue")
    got = linkage.link(side(c, "c", "raw"), side(p, "p", None)).collect()
    assert (1, 11) in {(r.citation_id, r.candidate_id) for r in got} and not {2} & {r.citation_id for r in got} and all(0 <= r.confidence <= 1 for r in got)
    v = linkage.votes(("a b c d", "", "", ["lee ann"], 2020, "", ""), ("a b c d", "", "", ["ann lee"], 2020, "", ""), "")
    assert linkage.kinds_of(np.array([v, [-1] * 10])).argmax(1).tolist() == [4, 0]


def test_linkage_sends_no_table_by_way_of_the_driver(spark, monkeypatch):
    schema = "id long, title string, raw string, authors array<string>, year int, doi string, venue string"
    side = lambda k: linkage.records(spark.createDataFrame([(1, "Quiet lakes under heavy snowfall", "", ["Lee, Ann"], 2020, "", "")], schema), k, "id", "title", "raw", "authors", "year", "doi", "venue")
    plans = []
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(linkage, "cut", lambda df, real=linkage.cut: plans.append(plan(df)) or real(df))
    result = linkage.link(side("c"), side("p"))
    assert [r.candidate_id for r in result.collect()] == [1]
    # but for the patterns of votes, whose number is bounded
    assert [p.count("BroadcastHashJoin") for p in [*plans, plan(result)]] == [0] * len(plans) + [1]


def test_cube_keeps_both_sums():
    r = np.random.default_rng(3)
    pi, size = np.full(500, 0.37), r.integers(10, 900, 500).astype(float)
    p = mixing.landing(mixing.flight(pi, size, r), size)
    assert set(np.unique(p)) <= {0.0, 1.0} and abs(p.sum() - pi.sum()) < 2 and abs((p * size).sum() - (pi * size).sum()) < 900


def test_mix(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], 10 + i % 5) for i in range(400)] + [(900, None, 5), (901, "a", None)], "id long, source string, n long")
    chosen, shares = mixing.mix(docs, "id", "source", "n", spark.createDataFrame([("a", 0.75, 1), ("b", 0.25, 2), ("z", 0.0, 1)], "source string, target_share double, max_repeats int"), total=2000)
    assert {r.source: r.reached_share for r in shares.collect()}["a"] == pytest.approx(0.75, abs=0.02)
    assert chosen.agg({"n_uses": "max"}).first()[0] == 1 and chosen.count() == chosen.select("id").distinct().count()


def test_shortfalls_are_spread():
    got = mixing.rates([("a", 0.5, 1, 1000), ("b", 0.4, 2, 100), ("c", 0.1, 1, 900), ("d", 0.0, 1, 5), ("e", 0.0, 0, 0)], 1000)
    assert got["b"] == 2.0 and got["d"] == 0.0 and sum(got[s] * n for s, n in (("a", 1000), ("b", 100), ("c", 900))) == pytest.approx(1000)
    assert got["a"] * 1000 / (got["c"] * 900) == pytest.approx(5) and mixing.rates([], 10) == {}
    assert mixing.rates([("a", 1.0, 1, 10)], 100) == {"a": 1.0}


def test_prototypes(spark):
    table = lookalike.prototypes(spark)
    assert len(table) > 3000 and all(text.skeleton(c, table) == text.skeleton(p, table) for c, p in zip("оցᎪⲟ", "ogAo"))
    for odd in ("тoй", "рaypal", "Ａ b"):
        assert text.skeleton(odd, table) != text.plainly(odd, table) and text.standins(odd, table)
    for own in ("Müller plain", "café"):
        assert text.skeleton(own, table) == text.plainly(own, table)


def test_subjects():
    docs = [(f"The {a} study looked at {a} in depth. Another line on {a} here. {a} again.", [s], "x") for s, a in (("law", "courts"), ("sport", "runners")) for _ in range(12)]
    m = subjects.Chain(docs, ["law", "sport"])
    f = lambda t: m.decode(m.features([set(subjects.terms(s)) for s in subjects.sentences(t)], "x"))
    assert f("courts matter. courts rule.\n\nReferences\nrunners runners.") == ["law"] and f("Nothing of note.") == []
    assert subjects.sentences("") == []


def test_blocking_survives_damage_to_leading_words(spark):
    schema = "id long, title string, raw string, authors array<string>, year int, doi string, venue string"
    side = lambda rows, k, raw: linkage.records(spark.createDataFrame(rows, schema), k, "id", "title", raw, "authors", "year", "doi", "venue")
    filler = [(100 + i, f"alpha{i % 7} beta{i % 5} gamma{i % 3} delta{i % 11} plain study", "", [f"Author{i} A"], 1990 + i % 20, "", "") for i in range(80)]
    title = "alpha1 beta2 quartz lichen tundra basalt glacier"
    held = side([(1, "alpha1 beta2 quarzt lichne tundra basalt glacier", "", ["Lee, Ann"], 2001, "", ""), *filler], "p", None)
    cited = [
        (1, title, "", ["Lee, Ann"], 2001, "", ""),  # two slips in the registry stand first there
        (2, title, "", None, None, "", ""),  # neither author nor year
        (3, "alpha1 beta2 quartz lichen tundra basalt", "", ["Lee, Ann"], 2001, "", ""),
        (4, title, "lee ann plain study gamma1 delta3 alpha4 beta3 delta5", ["Lee, Ann"], 2001, "", ""),
    ]
    counts = linkage._word_counts(held)
    keys = lambda df: {r.id: set(r["keys"]) for r in linkage.blocking_keys(df, counts).collect()}
    record = keys(held)[1]
    assert all(record & own for own in keys(side(cited, "c", "raw")).values())


def test_reference_list_headings_with_accents():
    assert subjects.sentences("One.\n\nBibliografía\nTwo.") == ["One."]


def _sets_one_by_one(hashes, shares, lead, expected, most, least):
    out, n = set(), len(hashes)
    sets = sorted((c for k in range(1, n + 1) for c in itertools.combinations(range(n), k)), key=len)
    whole = lambda c: (lead + sum(hashes[i] for i in c)) % 2**64
    few = {c for c in sets if len(c) >= least and expected * np.prod([shares[i] for i in c]) <= most}
    out = {(c[0], whole(c)) for c in few if not any(c[:k] in few for k in range(1, len(c)))}
    return out or ({(0, whole(sets[-1]))} if expected * np.prod(shares) <= linkage.MANY else set())


def test_blocking_sets_of_many_rows_are_those_of_each():
    r = random.Random(5)
    rows = [([r.getrandbits(64) for _ in range(5)], sorted(r.choice((1e-6, 1e-4, 0.003, 0.05, 0.6)) for _ in range(5)), r.getrandbits(64), r.choice((5.0, 700.0, 2e5, 1e7)), r.choice((0.02, 0.3)), r.choice((1, 2))) for _ in range(400)]
    got = [set() for _ in rows]
    for first, at, whole in linkage.selective_sets(*(np.array(x, np.uint64 if k in (0, 2) else float) for k, x in enumerate(zip(*rows)))):
        for i, w in zip(at.tolist(), whole.tolist()):
            assert (first, w) not in got[i]
            got[i].add((first, w))
    assert got == [_sets_one_by_one(*x) for x in rows]


def test_pairs_met_in_bins_are_those_that_share_keys(spark, monkeypatch):
    schema = "id long, title string, raw string, authors array<string>, year int, doi string, venue string"
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghik") for _ in range(6)) for _ in range(60)]
    held = [(100 + i, " ".join(r.sample(words, r.choice((0, 1, 2, 6, 9)))), "", [f"{r.choice(words)} A"], r.choice((None, 1990 + i % 4)), "", "") for i in range(150)]
    cited = [(i, *(h[1:] if r.random() < 0.7 else (None, h[1] + " 1 22", None, None, None, None))) for i, h in enumerate(r.sample(held, 80))]
    side = lambda rows, k, raw: linkage.records(spark.createDataFrame(rows, schema), k, "id", "title", raw, "authors", "year", "doi", "venue")
    cited, held = side(cited, "c", "raw"), side(held, "p", None)
    counts = linkage._word_counts(held)
    c, p = ({x.id: set(x["keys"]) for x in linkage.blocking_keys(df, counts).collect()} for df in (cited, held))
    want = {(i, j, len(a & b) + linkage.MEET * (min(len(a), len(b)) < linkage.MEET)) for i, a in c.items() for j, b in p.items() if a & b}
    for at_once, bins in ((50, 7), (1 << 21, 1)):
        monkeypatch.setattr(linkage, "AT_ONCE", at_once)
        both = pa.concat_tables([linkage.binned_keys(cited, counts, True, bins).toArrow(), linkage.binned_keys(held, counts, False, bins).toArrow()])
        got = {}
        for b in set(both["bin"].to_pylist()):
            for x in linkage.met_in_bin(both.filter(pc.equal(both["bin"], b))).to_pylist():
                got.setdefault((x["c"], x["p"]), []).append(x["n"])
        few = {(i, j) for i, j, _ in want if min(len(c[i]), len(p[j])) < linkage.MEET}
        assert {k: sum(n) for k, n in got.items() if k not in few} == {(i, j): n for i, j, n in want if (i, j) not in few}
        assert few <= got.keys() and all(sum(got[k]) >= linkage.MEET for k in few) and want


def test_linkage_leaves_no_shuffle_files_and_explodes_no_keys(spark, monkeypatch):
    schema = "id long, title string, raw string, authors array<string>, year int, doi string, venue string"
    side = lambda k: linkage.records(spark.createDataFrame([(i, f"Quiet lakes under heavy snowfall {i}", "", ["Lee, Ann"], 2020, "", "") for i in range(20)], schema), k, "id", "title", "raw", "authors", "year", "doi", "venue")
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    plans, left = [], []

    def cut(df, real=linkage.cut):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        before, result, end = files(), real(df), time.time() + 10
        while files() - before and time.time() < end:
            time.sleep(0.2)
        left.append(files() - before)
        return result

    monkeypatch.setattr(linkage, "cut", cut)
    assert linkage.link(side("c"), side("p")).count() >= 20
    assert len(plans) == 4 and left == [set()] * 4 and not any("Generate" in p for p in plans)
