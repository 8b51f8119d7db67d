"""De-duplication and merging against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from biblio_spark.functions.similarity import author_ratio, ratio
from biblio_spark.operators import dedup, fuzzy, merge
from biblio_spark.operators.components import connected_components
from biblio_spark.schema import RECORD_DDL


def record(ord_, title="", authors=(), ids=(), **article):
    """A row of RECORD_DDL."""
    fields = {
        "primary_doi": None, "title": title, "abstract": None, "language": "eng", "publication_year": None, "publication_date": None, "updated_date": None,
        "citation_count": None, "reference_count": None, "influential_citation_count": None, "is_open_access": None, "open_access_url": None,
    }
    source = article.pop("source", None)
    people = [(n, None, None, None, None, None, None, False, k + 1) for k, n in enumerate(authors)]
    return (ord_, str(ord_), tuple({**fields, **article}.values()), people, None, None, [(k, v, k == "doi") for k, v in ids], [], [], (source, None))


def records(spark, rows):
    return spark.createDataFrame(rows, RECORD_DDL)


def sequential(keys_by_ord):
    """kept and owner of each record, in order."""
    held, out = {}, {}
    for o in sorted(keys_by_ord):
        owner = next((held[k] for _, k in sorted(keys_by_ord[o]) if k in held), None)
        out[o] = o if owner is None else owner
        if owner is None:
            for _, k in keys_by_ord[o]:
                held.setdefault(k, o)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_seen_is_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows, keys = [], {}
    for o in range(120):
        ids = [(k, str(rng.randint(1, 25 if k == "doi" else 12))) for k in ("doi", "pmid", "arxiv_id") if rng.random() < 0.5]
        rows.append(record(o, ids=[*ids, ("pii", "same")]))
        keys[o] = [(("doi", "pmid", "arxiv_id").index(k), f"{k}:{v}") for k, v in ids]
    out = dedup.dedup_by_identifier(records(spark, rows)).select("ord", "kept", "owner_id").collect()
    assert {r["ord"]: r["owner_id"] for r in out} == sequential(keys)
    assert all(r["kept"] == (r["ord"] == r["owner_id"]) for r in out)


def test_chains(spark):
    rows = [record(1, ids=[("doi", "10.1/A")]), record(2, ids=[("doi", "doi:10.1/a"), ("pmid", "5")]), record(3, ids=[("pmid", "PMID5")]), record(4, ids=[("pmid", "none")]), record(5, ids=[("pmid", "-")])]
    lit = records(spark, rows)
    first = {r["ord"]: r["owner_id"] for r in dedup.dedup_by_identifier(lit).collect()}
    assert first == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    joined = {r["ord"]: r["owner_id"] for r in dedup.dedup_by_identifier(lit, "connected").collect()}
    assert joined == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    stats = dedup.dedup_stats(dedup.dedup_by_identifier(lit)).first()
    assert tuple(stats) == (5, 1, 0, 1, 4)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200, 200 + k) for k in range(1, 30)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(41)) and found[101] == 100 and all(found[200 + k] == 200 for k in range(30))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_three_records_become_two(spark):
    rows = [
        record(1, "A Study of Machine Learning", ["John Smith"], [("doi", "10.1000/test1")], source="pubmed", citation_count=3),
        record(2, "A study of machine learning!", ["Smith, John", "Ann Lee"], [("doi", "10.1000/test1"), ("pmid", "1")], source="arxiv", citation_count=9, abstract="x"),
        record(3, "Something else entirely here", ["Bob Ray"], [("doi", "10.1000/other")], source="wos"),
    ]
    marked = dedup.dedup_by_identifier(records(spark, rows))
    out = {r["owner_id"]: r for r in merge.merge_group(marked).collect()}
    assert set(out) == {1, 3}
    one = out[1]
    assert one["merge_count"] == 2 and one["merged_from_sources"] == ["pubmed", "arxiv"] and one["record_id"] == "2"
    assert [i["identifier_value"] for i in one["identifiers"]] == ["10.1000/test1", "1"]
    assert one["article"]["title"] == "A Study of Machine Learning" and one["article"]["citation_count"] == 9 and one["article"]["abstract"] == "x"


def test_full_merger(spark):
    rows = [
        record(1, "Short", ["A"], [("doi", "10.1/X")], source="pubmed", publication_year=2023, publication_date="2023", citation_count=15, is_open_access=False),
        record(2, "Much longer title here", ["A", "B"], [("doi", "10.1/x"), ("pmid", "1")], source="semantic_scholar", publication_year=2022, publication_date="2022-05", citation_count=0, is_open_access=True),
        record(3, "Equal long title here!", ["C", "D"], [], publication_date="2022-05-01"),
    ]
    row = merge.merge_records(records(spark, rows).withColumn("owner_id", F.lit(1))).first()
    a = row["article"]
    assert (a["title"], a["publication_year"], a["publication_date"], a["citation_count"], a["is_open_access"]) == ("Much longer title here", 2022, "2022-05", 15, True)
    assert [x["full_name"] for x in row["authors"]] == ["A", "B"] and len(row["identifiers"]) == 2
    assert (row["first_source"], row["primary_source"], row["merge_count"]) == ("pubmed", "pubmed", 3)
    assert row["source_counts"] == {"pubmed": 1, "semantic_scholar": 1, "unknown": 1}


def test_fuzzy_is_the_sequential_rule(spark):
    rng = random.Random(5)
    words = ["deep", "learning", "protein", "étude", "cell", "graph", "neural", "study", "x"]
    people = ["ann lee", "bob ray", "bob rayy", "cy ng", "dora m"]
    rows, plain = [], []
    for o in range(70):
        title = " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
        if plain and rng.random() < 0.5:
            title = list(rng.choice(plain)[1])
            for _ in range(rng.randint(0, 3)):
                title[rng.randrange(len(title))] = rng.choice("abcx")
            title = " ".join("".join(title).split())
        authors = rng.sample(people, rng.randint(0, 3))
        rows.append(record(o, title, authors))
        plain.append((o, title, authors))
    kept, want = [], {}
    for o, t, a in plain:
        t = " ".join(w for w in t.split() if w not in ("a", "an"))
        match = lambda u, b, t=t, a=a: t and u and (q := ratio(t, u)) >= 0.85 and ((q > 0.95) if not a or not b else author_ratio(a, b) >= 0.7)
        want[o] = next((p for p, u, b in kept if match(u, b)), o)
        if want[o] == o:
            kept.append((o, t, a))
    got = {r["ord"]: r["owner_id"] for r in fuzzy.dedup_fuzzy(records(spark, rows)).collect()}
    assert got == want


def test_empty_tables(spark):
    none = records(spark, [])
    assert dedup.dedup_by_identifier(none).count() == 0
    assert merge.merge_records(none.withColumn("owner_id", F.lit(1))).count() == 0


def test_long_chains_by_rounds_and_in_groups(spark):
    """Records 1-2, 2-3, 3-4, ... that share keys pairwise, and random keys, against the sequential rule."""
    import random

    from biblio_spark.operators.dedup import first_seen

    rng = random.Random(4)
    pairs = [(n, f"k{n + s}") for n in range(60) for s in (0, 1)] + [(100 + rng.randint(0, 80), f"r{rng.randint(0, 60)}") for _ in range(200)]
    seen, want = set(), {}
    for n in sorted({n for n, _ in pairs}):
        keys = {k for m, k in pairs if m == n}
        want[n] = not (keys & seen)
        seen |= keys if want[n] else set()
    shared = {k for k in {k for _, k in pairs} if len({n for n, x in pairs if x == k}) > 1}
    want = {n: kept for n, kept in want.items() if any(m == n and k in shared for m, k in pairs)}
    keys = spark.createDataFrame(pairs, "ord long, key string")
    for group, rounds in ((10**6, 3), (10**6, 0), (12, 1), (0, 3)):
        assert {r["ord"]: r["kept"] for r in first_seen(keys, group, rounds).collect()} == want
    assert first_seen(keys.limit(0)).count() == 0


def test_common_characters_bound_the_ratio(spark):
    """No pair that reaches a ratio is left out by its characters."""
    import random

    from pyspark.sql import functions as F

    from biblio_spark.functions.similarity import ratio
    from biblio_spark.operators.fuzzy import counts, may_match

    rng = random.Random(9)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abcdé xyz09ß") for _ in range(rng.randint(1, 30)))
        b = "".join(c if rng.random() < 0.85 else rng.choice("abqé ") for c in a)
        rows.append((a, b, ratio(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, r double").select("*", F.length("a").alias("n"), F.length("b").alias("m"))
    other = [c.alias(f"q{k}") for k, c in enumerate(counts("b", "m"))]
    out = df.select("r", "n", "m", *counts("a", "n"), *other).select("r", may_match("n", "m", 0.85).alias("may")).collect()
    assert all(r["may"] for r in out if r["r"] >= 0.85) and not all(r["may"] for r in out)


def test_ratio_from_is_the_ratio_or_none():
    """Long texts, in which frequent characters start no block, and very long ones too."""
    import time

    from biblio_spark.functions.similarity import common_length, ratio_from

    rng = random.Random(2)
    made = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    for letters, most in (("ab", 12), ("abcdefgh ", 60), ("abcdefghijklmnopqrstuvwxyz éß", 700)):
        for _ in range(120):
            a = made(rng.randint(0, most), letters)
            b = "".join(c if rng.random() < rng.choice((0.5, 0.9, 0.99)) else rng.choice(letters + "#") for c in a) if rng.random() < 0.7 else made(rng.randint(0, most), letters)
            for least in (0.8, 0.85, 0.95):
                r = ratio(a, b)
                assert ratio_from(a, b, least) == (r if r >= least else None)
            matched = common_length(a, b)
            assert 2 * matched >= ratio(a, b) * (len(a) + len(b)) - 1e-9 and (matched == len(a)) >= (a == b)
    # only frequent characters, and a common beginning
    same = "".join(f"other{k * k} " for k in range(60))
    for a, b in ((same, same), (same + "tail", same), (same, same + "tail"), ("ab" * 300, "ab" * 290)):
        assert ratio_from(a, b, 0.85) == ratio(a, b) >= 0.85
    long = [made(45_000, "abcdefghijklmnopqrstuvwxyz ") for _ in range(2)]
    began = time.time()
    assert ratio_from(*long, 0.85) is None and time.time() - began < 5


def brute_pairs(plain):
    """(later, earlier) of different (title, authors) by all pairs."""
    out = set()
    for k, (o, t, a) in enumerate(plain):
        for p, u, b in plain[:k]:
            if t and u and (t, a) != (u, b):
                q = ratio(t, u)
                if q > 0.95 if not a or not b else q >= 0.85 and author_ratio(a, b) >= 0.7:
                    out.add((o, p))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_fuzzy_pairs_are_all_pairs(spark, seed):
    """Titles of 1 to 260 characters, copies with a few changes, names that resemble each other or not, a sixth without authors."""
    rng = random.Random(seed)
    words = ["deep", "learn", "protein", "etude", "cell", "graph", "neural", "study", "x", "quark", "zeta"]
    people = ["ann lee", "bob ray", "bob rayy", "cy ng", "dora m", "ev", "evi", "bo"]
    plain = []
    for o in range(220):
        title = " ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 4, 9, 20, 45))))
        if plain and rng.random() < 0.6:
            title = list(rng.choice(plain)[1])
            for _ in range(rng.randint(0, 1 + len(title) // 12)):
                title[rng.randrange(len(title))] = rng.choice("bcxq")
            title = " ".join("".join(title).split())
        plain.append((o, title, sorted(rng.sample(people, rng.choice((0, 1, 1, 2, 2, 3))))))
    first = {}
    for o, t, a in plain:
        first.setdefault((t, tuple(a)), (o, t, a))
    want = brute_pairs(list(first.values()))
    got = {(r["ord"], r["earlier"]) for r in fuzzy.fuzzy_pairs(records(spark, [record(*p) for p in plain])).collect()}
    assert got == want and len(want) > 30


def test_merging_one_large_group_is_linear(spark):
    """Groups of equal identifiers and of distinct ones, with one record or many; the result has distinct elements in order."""
    import time

    from biblio_spark.schema import IDENTIFIER, PUBLICATION_TYPE, RECORD, SOURCE, struct_of

    def group(n):
        o = F.col("id")
        ids = F.array(*(struct_of(IDENTIFIER, identifier_type=F.lit(k), identifier_value=v.cast("string"), is_primary=F.lit(False)) for k, v in (("doi", o % 50), ("pmid", o % 7), ("doi", o % 3))))
        own = {"ord": o, "identifiers": ids, "publication_types": F.array(struct_of(PUBLICATION_TYPE, type_name=F.concat(F.lit("T"), (o % 4).cast("string")))), "source_specific": struct_of(SOURCE, source=F.when(o % 5 > 0, F.concat(F.lit("s"), (o % 5).cast("string"))))}
        return spark.range(n).select(*(own.get(c, F.lit(None)).cast(k).alias(c) for c, k in RECORD.items())).withColumn("owner_id", F.lit(0).cast("long"))

    times = {}
    for n in (6000, 100_000):
        rows = group(n)
        for function in (merge.merge_group, merge.merge_records):
            began = time.time()
            found = function(rows).collect()
            times[function, n] = time.time() - began
            assert len(found) == 1 and found[0]["merge_count"] == n
            values = [(i["identifier_type"], i["identifier_value"]) for i in found[0]["identifiers"]]
            seen = list(dict.fromkeys((k, str(o % m)) for o in range(60) for k, m in (("doi", 50), ("pmid", 7), ("doi", 3))))
            assert values == seen
            assert found[0]["merged_from_sources"] == (["s1", "s2", "s3", "s4"] if function is merge.merge_group else ["unknown", "s1", "s2", "s3", "s4"])
        assert dict(found[0]["source_counts"]) == {s: n // 5 for s in ("unknown", "s1", "s2", "s3", "s4")}
        assert [t["type_name"] for t in found[0]["publication_types"]] == ["T0", "T1", "T2", "T3"]
    assert all(times[f, 100_000] < 20 * times[f, 6000] + 5 for f in (merge.merge_group, merge.merge_records))


def plain_best(group):
    """What the quick merge keeps of records (ord, title, authors, ids): title of the first that has one, authors of the most complete, all ids."""
    score = lambda r: 10 * bool(r[1]) + min(2 * len(r[2]), 10) + min(3 * len(r[3]), 15)
    group = sorted(group)
    base = max(group, key=lambda r: (score(r), -r[0]))
    return group[0][0], next((r[1] for r in group if r[1]), ""), base[2], list(dict.fromkeys(i for r in group for i in r[3]))


@pytest.mark.parametrize("seed", [4, 5])
def test_deduplicate_is_both_rules_and_merges(spark, seed):
    rng = random.Random(seed)
    words, people = ["deep", "protein", "cell", "graph", "neural", "study"], ["ann lee", "bob ray", "cy ng"]
    plain = []
    for o in range(90):
        title = " ".join(rng.choice(words) for _ in range(rng.randint(2, 5)))
        if plain and rng.random() < 0.5:
            title = list(rng.choice(plain)[1])
            title[rng.randrange(len(title))] = rng.choice("bcx")
            title = " ".join("".join(title).split())
        ids = [(k, str(rng.randint(1, 40))) for k in ("doi", "pmid") if rng.random() < 0.4]
        plain.append((o, title, rng.sample(people, rng.randint(0, 2)), ids))
    owner = sequential({o: [(("doi", "pmid").index(k), f"{k}:{v}") for k, v in ids] for o, _, _, ids in plain})
    groups = {}
    for r in plain:
        groups.setdefault(owner[r[0]], []).append(r)
    exact = [plain_best(g) for _, g in sorted(groups.items())]
    kept, near = [], {}
    for o, t, a, ids in exact:
        match = lambda u, b, t=t, a=a: (q := ratio(t, u)) >= 0.85 and ((q > 0.95) if not a or not b else author_ratio(a, b) >= 0.7)
        near[o] = next((p for p, u, b, _ in kept if match(u, b)), o)
        if near[o] == o:
            kept.append((o, t, a, ids))
    groups = {}
    for r in exact:
        groups.setdefault(near[r[0]], []).append(r)
    want = {o: (plain_best(g)[1], len(g), len(plain_best(g)[3])) for o, g in groups.items()}
    unique, stats = fuzzy.deduplicate(records(spark, [record(*r) for r in plain]))
    got = {r["owner_id"]: (r["article"]["title"], r["merge_count"], len(r["identifiers"])) for r in unique.collect()}
    assert got == want and len(want) < len(exact) < len(plain)
    assert tuple(stats.first()) == (len(plain), len(plain) - len(exact), len(exact) - len(want), len(plain) - len(want), len(want))
