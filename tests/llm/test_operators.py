"""Each operator against its plain version, over a table with nulls, empty and long texts, ties, copies and columns
whose names clash with the operators' own."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowloom.llm import common, decontaminate, grams, graph, language, licenses, mixing, pii, prefix, quality, sharding, simhash, substring, urls
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, h long, key string, id string, rank int, kept string, fp string, size string, words string"
RNG = random.Random(5)
VOCABULARY = [a + b for a in ("the", "on", "re", "ing", "É", "ß", "Zu") for b in ("a", "st", "er", "", ".", ",")]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


PASSAGE, OTHER = prose(60), prose(45)
ITEMS = [(1, PASSAGE), (2, " ".join(OTHER.split()[5:30])), (3, "short item here"), (4, ""), (5, None), (None, prose(20)), (10, PASSAGE), (6, "one")]


def texts():
    rng = random.Random(6)
    base = [prose(n, rng) for n in (0, 1, 2, 3, 5, 10, 19, 20, 21, 40, 90, 300)]
    near = base[-1].split()
    near[150] = "changed"
    return [
        *base,
        None,
        "",
        " \n\t ",
        base[-1],
        " ".join(near),
        base[9],
        base[9] + " " + PASSAGE,
        PASSAGE + "\n" + PASSAGE,
        OTHER,
        prose(10, rng) + " " + " ".join(OTHER.split()[:25]) + " " + prose(30, rng),
        "short ITEM here; one",
        "from " * 40,
        "a b c d e a b c d e f",
        "line one\nline two\nline one\n\n \nline one",
        "### $$$ x" * 9,
        "Licensed under CC BY-NC 4.0. All rights reserved. cc by cc by",
        "GNU General Public License; released under the new MIT license",
        prose(5000, rng),
        prose(300, rng) + " one",
        "mail a.b@x.example.org and +1 (487) 555-7209, 4111 1111 1111 1111 or 10.0.0.255 10.0.0.256 1.2.3.4.5.6.7.8 a@b.c_d@e.f",
        "É" * 7 + " 𝄞 x@y.zz 4111-1111-1111-1111-2 +12 345 +1234567890123456 0001.2.3.4 " + "7" * 3000,
        "a" * 20000 + "@ 1.1.1 " + "+1" * 50,
        "Contact Dr. Jane Miller, phone (555) 123-4567, id 123-45-6789, version 1.2.3 token 99999999",
    ]


def docs(spark, rows=None):
    rows = list(enumerate(texts())) if rows is None else rows
    return spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 3}" if (d or 0) % 7 else None, 1, 1, "k", "i", 1, "k", "f", "s", "w") for d, t in rows], SCHEMA)


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def odd_rows():
    """Repeated rows, an id with two texts, and null ids."""
    return [*enumerate(texts()), (3, texts()[3]), (11, texts()[11]), (9, OTHER), (None, PASSAGE), (None, None)]


def empty(spark):
    return docs(spark, [])


def items(spark, rows=None):
    return spark.createDataFrame(ITEMS if rows is None else rows, "item_id long, text string").withColumn("window", F.lit(1)).withColumn("words", F.lit(1))


def test_contamination(spark):
    out = decontaminate.contamination(docs(spark, odd_rows()), items(spark))
    got = out.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ",").cast("binary"), 256), "contaminated")
    want = brute.contamination(odd_rows(), ITEMS)
    assert plain(got) == sorted(want, key=repr) and any(r[5] for r in want) and any(r[2] and not r[5] for r in want)


def test_contamination_of_nothing(spark):
    assert decontaminate.contamination(empty(spark), items(spark)).count() == 0
    out = decontaminate.contamination(docs(spark), items(spark, []))
    assert out.where("contaminated or n_hit > 0").count() == 0 and out.count() == len(texts())


def test_contaminated_documents_go(spark):
    rows = odd_rows()
    bad = [r[-1] for r in brute.contamination(rows, ITEMS)]
    out = decontaminate.drop_contaminated(docs(spark, rows), items(spark))
    assert out.columns == docs(spark).columns
    assert plain(out.select("doc_id", "text")) == sorted([r for r, b in zip(rows, bad, strict=True) if not b], key=repr)


def test_contamination_past_the_broadcast_limit(spark, monkeypatch):
    rng = random.Random(4)
    rows = [*odd_rows(), *[(100 + i, f"{prose(4000, rng)} {PASSAGE} {prose(4000, rng)}") for i in range(6)]]
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    out = decontaminate.contamination(docs(spark, rows), items(spark))
    got = out.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ",").cast("binary"), 256), "contaminated")
    assert plain(got) == sorted(brute.contamination(rows, ITEMS), key=repr)


def test_gram_places(spark):
    df = docs(spark, [(1, "a b c d"), (2, "")])
    wanted = spark.createDataFrame([("b c",), ("c d",)], "g string").select(F.get(grams.grams(F.split("g", " "), 2), F.lit(0)).alias("h"))
    found = grams.gram_places(df, "doc_id", "text", wanted, [1, 2])
    assert sorted((r.pos, r.size) for r in found.where("h is not null").collect()) == [(1, 2), (2, 2)]
    assert found.where("marks").count() == 2
    counts = grams.gram_counts(df.unionByName(df), "text", wanted, [1, 2])
    assert [r.times for r in counts.collect()] == [2, 2]


def test_quality_statistics(spark):
    df, names = quality.judge(docs(spark, odd_rows()), [])
    got = df.select("doc_id", *[names[k] for k in [*quality.STATS, "base_failed"]])
    assert plain(got) == sorted([(d, *brute.quality(t)) for d, t in odd_rows()], key=repr)
    assert {"kept", "n_words"} <= set(df.columns) and names["kept"] != "kept"


@pytest.mark.parametrize("seed", range(4))
def test_repeated_words(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("ab" if i % 2 else "abcdefgh") for _ in range(rng.randint(0, 90)))) for i in range(60)]
    df, names = quality.judge(docs(spark, rows), [])
    assert plain(df.select("doc_id", names["n_repeat_words"])) == sorted([(d, brute.quality(t)[4]) for d, t in rows], key=repr)


def test_rules_are_learned(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(("%%%" if i % 4 == 0 else "") + w for w in prose(rng.randint(20, 60), rng).split())) for i in range(400)]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(0, 400, 2)] + [(None, 0), (1, None)], "doc_id long, quality int")
    rules = quality.fit(docs(spark, rows), labels)
    df, names = quality.judge(docs(spark, rows), rules)
    wrong = df.where(F.col(names["kept"]) == (F.col("doc_id") % 4 == 0)).count()
    assert rules and wrong == 0
    kept = quality.keep_good(docs(spark, rows), labels)
    assert kept.columns == docs(spark).columns and kept.count() == 300


def test_rules_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs(spark), labels) == [] and quality.fit(empty(spark), labels) == []
    assert quality.keep_good(empty(spark), labels).count() == 0


def test_simhash_groups(spark):
    rows = odd_rows()
    out = simhash.groups(docs(spark, rows)).select("doc_id", simhash.hex_digits(F.col("fp")), "component_id")
    assert plain(out) == sorted(brute.groups(rows), key=repr)
    assert simhash.groups(empty(spark)).count() == 0


@pytest.mark.parametrize("dense", [simhash.DENSE, 3, 1])
def test_links_connect_all_near_values(spark, dense):
    rng = random.Random(3)
    values = {0, 1, 3, 7, (1 << 64) - 1, 1 << 63}
    for _ in range(30):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(12):
            values.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    crowd = rng.getrandbits(32)  # one segment in common
    values |= {crowd | rng.getrandbits(32) << 32 for _ in range(90)} | {crowd | 7 << 32 ^ 1 << b for b in range(64)}
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = graph.components(simhash.links(spark.createDataFrame(signed, "fp long"), dense=dense))
    root = {r.node: r.root for r in found.collect()}
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    signed_of = dict(zip(values, [s for (s,) in signed], strict=True))
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            same = root.get(signed_of[a], signed_of[a]) == root.get(signed_of[b], signed_of[b])
            assert same == (find(a) == find(b))


def test_groups_past_their_broadcast_limit(spark, monkeypatch):
    asked = []

    def counted(df, rows=None, size=None):
        asked.append(rows)
        return common.small(df, rows, size)

    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 2)
    for module in (simhash, graph):
        monkeypatch.setattr(module, "small", counted)
    rows = odd_rows()
    out = simhash.groups(docs(spark, rows), "doc_id").select("doc_id", simhash.hex_digits(F.col("fp")), "component_id")
    assert plain(out) == sorted(brute.groups(rows), key=repr)
    ids = [r.doc_id for r in simhash.keep_one(docs(spark, [r for r in rows if r != (9, OTHER)])).collect()]
    assert len(ids) == len(set(ids)) and set(asked) == {2}


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_probes_and_large_tables_are_not_broadcast(spark):
    """However small Spark takes their files to be: it sizes the probes, 33 for each print, as it does the prints."""
    prints = spark.range(300).select(F.xxhash64("id").alias("fp"))
    assert "Broadcast" not in planned(simhash.links(prints))
    counted = common.cut(prints, "counted")
    assert "Broadcast" in planned(prints.join(common.small(counted, 300), "fp"))
    for kind in ("inner", "left", "left_semi", "left_anti"):
        assert "Broadcast" not in planned(prints.join(common.small(counted, 299), "fp", kind))


def test_one_of_each_group_stays(spark):
    rows = [r for r in odd_rows() if r != (9, OTHER)]
    out = simhash.keep_one(docs(spark, rows))
    assert out.columns == docs(spark).columns
    kept = sorted({c for _, _, c in brute.groups(rows) if c is not None})
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == kept


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (None, 3)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == dict.fromkeys(range(51), 0) | dict.fromkeys(range(1000, 1200), 1000)
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_license_base(spark):
    out = licenses.scan(docs(spark, odd_rows())).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert plain(out) == sorted([(d, *brute.licenses(t)) for d, t in odd_rows()], key=repr)
    assert licenses.scan(empty(spark)).count() == 0


def test_license_templates(spark):
    found = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs(spark)).collect()}
    by = {t: found[i] for i, t in enumerate(texts())}
    assert by["Licensed under CC BY-NC 4.0. All rights reserved. cc by cc by"][0] == "cc-by,cc-by-nc,reserved"
    assert by[PASSAGE + "\n" + PASSAGE] == ("", 0.0)
    changed = "permission is hereby granted free of any charge to any person obtaining a copy of this great software and associated documentation files"
    assert licenses.scan(docs(spark, [(1, "x " + changed)])).first().labels == "mit"


def test_shards(spark):
    rows = odd_rows()
    out = [r.asDict() for r in sharding.shard_by_bytes(docs(spark, rows), 4).collect()]
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in out) == sorted((d or -1, len((t or "").encode()) + 16, brute.crc(t)) for d, t in rows)
    total, most = sum(r["size"] for r in out), max(r["size"] for r in out)
    for s in range(4):
        own = sorted((r for r in out if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 4) <= most
    ends = [(min(x), max(x)) for s in range(4) if (x := [r["doc_id"] or -1 for r in out if r["shard"] == s])]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert sharding.shard_by_bytes(empty(spark)).count() == 0


def test_prefix_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("a"), (F.col("id") % 5).alias("s"))
    out = prefix.with_prefix(df, ["a", "s"], {"s": "b"}, "r").orderBy("r").collect()
    total = 0
    for i, r in enumerate(out):
        assert (r.a, r.r, r.b) == (i, i, total)
        total += r.s


def test_running_sums(spark):
    values = [[], [3], list(range(1000))]
    df = spark.createDataFrame([(v,) for v in values], "v array<bigint>")
    got = [r[0] for r in df.select(common.running_sums(F.col("v"), 16)).collect()]
    assert got == [[sum(v[:i]) for i in range(len(v))] for v in values]


def test_url_rules(spark):
    given = [
        None, "", "no scheme", "http://X.Net/", "http://net", "http://net/", "https://a.example.NET/en/1#top", "http://example.net/fr/", "http://b.example.com/de/x?y=/fr/",
        "http://w.org/fr/", "http://w.org?/fr/", "ftp://fnet/", "x://a://net/", "http://example.com/DE/",
    ]
    pages = spark.createDataFrame([(i, u, None, "r") for i, u in enumerate([*given, given[3]])], "page_id long, url string, html string, rule string")
    out = plain(urls.judge(pages).select("page_id", "host", "path", "rule"))
    assert out == sorted([(i, *brute.url(u)[:3]) for i, u in enumerate([*given, given[3]])], key=repr)
    assert urls.judge(pages.limit(0)).count() == 0


def test_decisions_spread(spark):
    def canonical(u):
        return f"<html><LINK href='{u}' rel=canonical></html>"

    rows = [
        (1, "http://a.io/1", canonical("http://spam.net/x")),
        (2, "http://a.io/2", '<meta http-equiv="Refresh" content="0; URL=/1">'),
        (3, "http://example.net/en/ok", canonical("http://spam.net/x")),
        (4, "http://spam.net/x", None),
        (5, "http://c.io/", canonical("http://bad.net/")),
        (6, "http://d.io/", None),
        (7, "http://c.io/#f", ""),
        (8, "https://www.example.com/de", None),
        (9, "http://m.example.com/de/?utm_source=feed", None),
    ]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: (r.verdict, r.via) for r in out.collect()}
    assert got[1] == got[2] == ("allow", "alias") and got[3] == ("allow", "rule") and got[4] == ("block", "rule")
    assert got[5] == got[7] == ("block", "alias") and got[6] == ("allow", "default")
    assert got[8] == ("block", "alias") and got[9] == ("block", "rule")
    more = spark.createDataFrame([("http://d.io/", "http://bad.net/")], "source string, target string")
    assert urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), more).where("page_id = 6").first().verdict == "block"


def test_links_in_pages(spark):
    rows = [
        ("http://a.io/x/y/z", '<link rel="canonical" href="../q?a=1&amp;b=2">', "a.io/x/q?a=1&b=2"),
        ("http://a.io/x/y", '<base href="//b.io/c/"><link rel=canonical href=d>', "b.io/c/d"),
        ("http://a.io", "<link rel='canonical' href='./e/../f/'>", "a.io/f/"),
        ("http://a.io/k?z", '<meta http-equiv=refresh content="5;url=?y">', "a.io/k?y"),
        ("http://a.io/k", '<link rel="stylesheet" href="canonical.css">', None),
    ]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    found = {r.u: r.v for r in urls.page_links(pages).collect()}
    assert found == {u.split("://")[1]: v for u, _, v in rows if v}


def test_canonical_forms(spark):
    forms = {"www.a.io/b/": "a.io/b", "m.a.io": "a.io", "a.io/": "a.io", "a.io/i/index.html?utm_source=f&b=1&ref=x": "a.io/i?b=1", "a.io/b.htm": "a.io/b", "a.io/?ref=": "a.io", "a.io/b?c=d&e": "a.io/b?c=d&e"}
    df = spark.createDataFrame(list(forms.items()), "u string, want string").withColumn("got", urls.canonical_node(F.col("u")))
    df = df.withColumn("again", urls.canonical_node(F.col("got")))
    assert df.where("got <> want or again <> got").collect() == []


def test_a_hub_that_very_many_pages_name(spark):
    spam = '<link rel="canonical" href="http://spam.net/hub">'
    pages = spark.range(30000).select(
        F.col("id").alias("page_id"),
        F.concat(F.lit("http://site"), F.col("id"), F.lit(".io/p")).alias("url"),
        F.when(F.col("id") % 3 == 0, spam).when(F.col("id") % 3 == 1, F.concat(F.lit('<link rel=canonical href="http://site'), F.col("id") - 1, F.lit('.io/p">'))).alias("html"),
    )
    out = urls.judge(pages)
    counts = {(r.verdict, r.via): r["count"] for r in out.groupBy("verdict", "via").count().collect()}
    assert counts == {("block", "alias"): 20000, ("allow", "default"): 10000}


def test_targets(spark):
    sizes = {"a": 100, "b": 1000, "c": 50, "d": 10, None: 40}
    out = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    got = {r.source: r.target for r in out.collect()}
    weights, full, left = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {}, 1.5 * sum(sizes.values())
    while True:  # deal, stop what is above, deal again
        rest = {k: w for k, w in weights.items() if k not in full}
        share = {k: (left - sum(full.values())) * w / sum(rest.values()) for k, w in rest.items()}
        above = {k: 2.0 * sizes[k] for k, v in share.items() if v > 2 * sizes[k]}
        if not above:
            break
        full |= above
    assert got == pytest.approx(full | share)


def test_permutation(spark):
    for n in (1, 2, 3, 64, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), [F.lit(7)]).alias("x"))
        assert sorted(r.x for r in df.collect()) == list(range(n))


def test_mix(spark):
    rows = [*odd_rows(), *[(100 + i, prose(40 + i)) for i in range(60)]]
    result, slots = mixing.mix(docs(spark, rows), block=8, slots_per_shard=50)
    out, slots = result.collect(), slots.collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in out)
    by_source = {s: [r for r in out if r.source == s] for s in {r.source for r in out}}
    rank = {s: i for i, s in enumerate(sorted(by_source, key=lambda s: (s is None, s)))}
    for s, own in by_source.items():
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(0.1 * own[0].target, 16)
        # brute force: each slot reads its block's words of the source's stream, in the order of ids, keys and sizes
        reads = Counter(r.block for r in slots if r.source_rank == rank[s])
        place = 0
        for r in sorted(own, key=lambda r: (r.doc_id is not None, r.doc_id or 0, bytes(r.key), r.size)):
            assert r.taken == sum(reads[w // 8] for w in range(place, place + r.size))
            place += r.size
        n = -(-place // 8)
        assert all(reads[b] <= 2 for b in range(n)) and set(reads) <= set(range(n)) and (max(reads.values()) < 2 or min(reads[b] for b in range(n)) >= 1)
    assert len({(r.out_shard, r.out_slot) for r in slots}) == len(slots) and max(Counter(r.out_shard for r in slots).values()) <= 50
    draws = [Counter(r.source_rank for r in slots if r.out_shard == s) for s in sorted({r.out_shard for r in slots})[:-1]]
    assert len({tuple(sorted(d.items())) for d in draws}) > 1  # shards' counts are drawn, not dealt
    assert all(max(d[k] for d in draws) - min(d[k] for d in draws) <= len(rank) + 1 for k in rank.values())
    again, _ = mixing.mix(docs(spark, rows).repartition(3), block=8, slots_per_shard=50)
    assert plain(again.select("doc_id", "size", "taken")) == plain(result.select("doc_id", "size", "taken"))
    assert mixing.mix(empty(spark))[0].count() == 0


def test_the_mix_in_blocks(spark):
    rows = [*odd_rows(), *[(100 + i, prose(40 + i)) for i in range(60)]]
    blocks = mixing.mixed_blocks(docs(spark, rows), block=8, slots_per_shard=50).collect()
    result, slots = mixing.mix(docs(spark, rows), block=8, slots_per_shard=50)
    out = result.collect()
    assert len(blocks) == slots.count() and sum(len(b.words) for b in blocks) == sum(r.taken for r in out)
    words = {}
    for r in sorted(out, key=lambda r: (r.source_rank, r.start)):
        text = next(t for d, t in rows if d == r.doc_id and len((t or "").split()) == r.size and hashlib.md5((t or "").encode()).digest() == bytes(r.key))
        words.setdefault(r.source_rank, []).extend(brute.SPACE_WORD.findall(text or ""))
    assert all(list(b.words) == words[b.source_rank][b.block * 8 : b.block * 8 + 8] for b in blocks)
    assert mixing.mixed_blocks(empty(spark)).count() == 0


def test_words_in_blocks_are_not_broadcast(spark):
    """However small Spark takes the file of the documents to be that they are exploded from."""
    plan = planned(mixing.mix(docs(spark), block=8, slots_per_shard=64)[0])
    assert re.search(r"SortMergeJoin \[source_rank#\d+L?, block#", plan) and re.search(r"SortMergeJoin \[rank#", plan)
    assert not re.search(r"BroadcastHashJoin \[(source_rank|rank)#", plan)


def test_resample(spark):
    rows = [(i, prose(30)) for i in range(300)]
    out = mixing.resample(docs(spark, rows))
    copies = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert out.columns == docs(spark).columns and set(copies.values()) <= {1, 2}
    assert abs(sum(copies.values()) - 450) < 60
    assert mixing.resample(empty(spark)).count() == 0


def test_resample_of_equal_rows(spark):
    df = docs(spark, [(1, prose(40))] * 5 + [(None, "a b c")] * 2 + [(7, "one"), (7, "two")]).withColumn("a.b", F.rand(1)).withColumn("mix_n", F.lit(1)).withColumn("mix_id", F.lit(1)).withColumn("range_part", F.lit(1))
    result, _ = mixing.mix(df)
    words = {r["doc_id"]: r["n"] for r in result.groupBy("doc_id").agg(F.sum("taken").alias("n")).collect()}
    out = mixing.resample(df)
    got = Counter(r.doc_id for r in out.collect())
    assert out.columns == df.columns and abs(got[1] - words[1] / 40) < 5 and len({r["a.b"] for r in out.where("doc_id = 1").collect()}) == min(5, got[1])


def test_languages(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(table, language.samples(table)).join(table, "doc_id").where(language.held_out(F.col("doc_id")))
    assert out.where("lang_pred = lang").count() >= 0.97 * out.count() and out.where("score < 0 or score > 1").count() == 0


def test_languages_of_odd_texts(spark):
    learned = {"en": ["the cat and the dog"], "de": ["der hund und die katze"]}
    rows = [(1, None), (2, " 12 "), (3, "the dog"), (4, "die katze"), (5, "² ½ Ⅷ ٣"), (None, "the cat"), (3, "der hund"), (6, "")]
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in language.identify(docs(spark, rows), learned).collect()}
    assert got == {(1, "und", False), (2, "und", False), (3, "en", True), (4, "de", True), (5, "und", False), (None, "en", True), (3, "de", True), (6, "und", False)}
    assert language.identify(docs(spark), {}).where("lang_pred <> 'und'").count() == 0
    assert language.identify(empty(spark), learned).count() == 0
    assert language.samples(empty(spark)) == {}


def line(text):
    return " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "


def cross_parsing(text, learned):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i:j] in learned and text[i : j + 1] in learned:
            j += 1
        n, i = n + 1, j
    return n


def test_cross_parsing_of_whole_texts():
    rng = random.Random(2)

    def made(letters, n):
        return "".join(rng.choice(letters) for _ in range(n))

    learned = {"a": [made("abc .", 300), made("ab ", 50)], "b": [made("bcdé 1", 200)], "c": [""]}
    model = language.Model(learned)
    texts = [made("abcdé .", rng.choice([1, 5, 40, 400])) for _ in range(60)] + [made("ab", 3000), "  ", "xyz", made("bc", 20000)]
    lines = [line(t) for t in texts if line(t) != "  "]
    got = model.counts([language.letters(t) for t in texts if line(t) != "  "])
    for k, name in enumerate(model.languages):
        whole = "".join(line(t) for t in learned[name] if t)
        assert got[k].tolist() == [cross_parsing(t, whole) for t in lines]
    best = model.predict(texts)
    rates = iter(got.T / [[len(x)] for x in lines])
    for t, (name, score) in zip(texts, best, strict=True):
        if line(t) == "  ":
            assert (name, score) == ("und", 0.0)
        else:
            r = next(rates).tolist()
            assert name == model.languages[r.index(min(r))] and score == pytest.approx(sorted(r)[1] / sum(sorted(r)[:2]))


def test_samples_are_bounded(spark):
    rows = [(1, "same words")] * 300 + [(i, f"word {'x' * i}") for i in range(2, 40)] + [(50, "long " * 3000)]
    found = language.samples(docs(spark, rows))
    assert len(found["en"]) == language.DOCS_PER_LANGUAGE and len(set(found["en"])) == len(found["en"]) and max(map(len, found["en"])) <= language.SAMPLE_CHARS
    assert language.samples(docs(spark, [(1, "long " * 3000)])) == {"en": ["long " * 3000]}


def test_phrases_against_all_substrings():
    rng = random.Random(2)
    text = "".join(rng.choice("abc ") for _ in range(200))
    automaton = language.SuffixAutomaton(text)
    for _ in range(200):
        s = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 25)))
        assert automaton.phrases(s) == cross_parsing(s, text)


def test_repeats(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    out = substring.remove_repeats(docs(spark, rows))
    got = out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256))
    want = brute.repeats(rows)
    assert plain(got) == sorted(want, key=repr) and sum(r[2] > 0 for r in want) >= 5
    assert substring.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_at_random(spark, seed):
    rng = random.Random(seed)
    passages = [prose(rng.randint(20, 60), rng) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [prose(rng.randint(0, 30), rng) for _ in range(3)] + [rng.choice(passages) for _ in range(rng.randint(0, 2))]
        rng.shuffle(parts)
        if i % 9 == 0:
            parts.append("x y " * rng.randint(5, 30))
        rows.append((i * 3, " ".join(parts)))
    want = sorted(brute.repeats(rows), key=repr)
    for more in ({}, {"deal_bytes": 1500}, {"deal_rows": 2}, {"deal_bytes": 3000, "deal_rows": 9}):
        out = substring.remove_repeats(docs(spark, rows), shard_bytes=2000, **more)
        got = out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256))
        assert plain(got) == want


def test_a_passage_that_most_documents_share(spark):
    rng = random.Random(8)
    shared = prose(50, rng)
    rows = [(i, f"{prose(12, rng)} {shared} {prose(9, rng)}" if i % 3 else prose(60, rng)) for i in range(240)]
    out = substring.remove_repeats(docs(spark, rows), shard_bytes=4000, deal_rows=10)
    assert plain(out.select("doc_id", "n_words", "n_removed")) == sorted([r[:3] for r in brute.repeats(rows)], key=repr)


def test_the_automaton_decides(spark, monkeypatch):
    texts = [b"a b c d e f".split(), b"x b c d e y".split(), b"b c d z".split()]
    spell = substring.Codes(sorted({w for t in texts for w in t}))
    codes = [spell.of(t) for t in texts]
    passages = substring._recurring(codes, spell.digits, substring.np.zeros(3, bool), 3)
    assert sorted(passages) == sorted({spell.of(b"b c d e".split()), spell.of(b"b c d".split())})
    stretch, place, number = substring._located(codes, passages, spell.digits, 3)
    found = {(s, p): n for s, p, n in zip(stretch.tolist(), place.tolist(), number.tolist(), strict=True)}
    assert set(found) == {(0, 1), (0, 2), (1, 1), (1, 2), (2, 0)} and found[0, 1] == found[1, 1] == found[2, 0] != found[0, 2] == found[1, 2]
    # passages that aren't in the automaton aren't found
    assert not len(substring._located(codes, [spell.of(b"f a b".split())], spell.digits, 3)[0])


def test_repeats_of_text_ids(spark):
    same = prose(30)
    rows = [("b", same), ("a", "x " + same), ("c", same + " y"), (None, same)]
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string"))
    assert plain(out.select("doc_id", "n_removed")) == sorted([("a", 0), ("b", 30), ("c", 30), (None, 30)], key=repr)


def test_repeats_of_odd_ids(spark):
    same = prose(30)
    out = plain(substring.remove_repeats(docs(spark, [(1, same), (1, same), (None, same), (2, "x " + same)])).select("doc_id", "n_words", "n_removed"))
    assert out == sorted([(1, 30, 0), (1, 30, 0), (None, 30, 30), (2, 31, 30)], key=repr)


def test_personal_data(spark):
    rows = odd_rows()
    out = pii.find(docs(spark, rows))
    base = F.concat(*[pii.listed(k, F.col(f"base.{k}")) for k in pii.KINDS])
    got = out.select("doc_id", *[F.size(f"base.{k}") for k in pii.KINDS], F.sha2(F.array_join(base, ",").cast("binary"), 256))
    assert plain(got) == sorted([(d, *brute.personal(t)) for d, t in rows], key=repr)
    assert pii.find(empty(spark)).count() == 0


def test_personal_data_at_random(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(["1", "23", "4111", " ", "-", ".", "+", "@", "a", "É", "(", ")", "_", "x.y", "255", "0"]) for _ in range(rng.randint(0, 80)))) for i in range(400)]
    out = pii.find(docs(spark, rows))
    base = F.concat(*[pii.listed(k, F.col(f"base.{k}")) for k in pii.KINDS])
    got = out.select("doc_id", *[F.size(f"base.{k}") for k in pii.KINDS], F.sha2(F.array_join(base, ",").cast("binary"), 256))
    assert plain(got) == sorted([(d, *brute.personal(t)) for d, t in rows], key=repr)


def test_added_spans(spark):
    rows = [(i, f"{'phone' if i % 2 else 'version'} {'(555) 123-4567' if i % 2 else '1.22.333.4444.5'} end") for i in range(60)]
    found = pii.find(docs(spark, rows)).select("doc_id", F.size("more").alias("n")).collect()
    assert all((r.n == 1) == (r.doc_id % 2 == 1) for r in found)


def planted(rng):
    """(text, wanted spans, decoys): personal data that no base kind has, with or without a cue, and what only looks like it."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    wanted = [
        f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{digits(4)}",
        f"{rng.randint(200, 999)}-{rng.randint(10, 99)}-{digits(4)}",
        f"a{hexes(30)}7",
        f"{rng.choice(['Dr', 'Mrs', 'Herr'])}. {rng.choice(['Jane', 'Peter', 'Ursula'])} {rng.choice(['Miller', 'Schmidt'])}",
        f"@{rng.choice(['jane', 'peter', 'maria'])}_{digits(3)}",
    ]
    decoys = [f"{rng.randint(1990, 2025)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{digits(2)}.{digits(3)}.{digits(3)}", f"978-{digits(10)}", digits(8)]
    cues = ["phone", "ssn", "token =", "dear", "follow"], ["date", "version", "isbn", "item"]
    parts, at, places = [], 0, ([], [])
    for kind, (values, words) in enumerate(zip((wanted, decoys), cues, strict=True)):
        for v, w in zip(values, words, strict=True):
            lead = f"{prose(6, rng)} {w + ' ' if rng.random() < 0.6 else ''}"
            parts.append(lead + v + " , ")
            places[kind].append((at + len(lead), at + len(lead) + len(v)))
            at += len(parts[-1])
    return "".join(parts), *places


def test_recall_of_added_spans(spark):
    rng = random.Random(3)
    made = [planted(rng) for _ in range(150)]
    out = pii.find(docs(spark, [(i, t) for i, (t, _, _) in enumerate(made)])).collect()
    found = {r.doc_id: {(x.s, x.e) for k in (*[r.base[k] for k in pii.KINDS], r.more) for x in k} for r in out}
    caught = [span in found[i] for i, (_, wanted, _) in enumerate(made) for span in wanted]
    wrong = [span in found[i] for i, (_, _, decoys) in enumerate(made) for span in decoys]
    assert sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.1 * len(wrong)
    assert {x.kind for r in out for x in r.more} == {"number", "handle", "name", "secret"}


def test_span_features_decide_where_labelers_are_silent():
    chance = pii.fit({"++0+0+n2110": 50, "++000+n2110": 40, "00000+n2110": 4, "00000+n1000": 4, "--0-0-n1000": 60, "--000-n1000": 50})
    assert chance["00000+n2110"] > chance["00000+n1000"]


def test_check_digits(spark):
    df = spark.createDataFrame([("GB82WEST12345698765432",), ("GB82WEST12345698765433",)], "c string")
    assert [r[0] for r in df.select(pii.mod_97(F.col("c"))).collect()] == [True, False]


def test_reliabilities_are_learned():
    chance = pii.fit({"++0+0+n2110": 50, "--0-00n1000": 60, "0000+0n3310": 5, "+-0000n2110": 3})
    assert chance["++0+0+n2110"] > 0.9 and chance["--0-00n1000"] < 0.1 and pii.fit({}) == {}
