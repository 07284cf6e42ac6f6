"""Operators on small tables: ties, nulls, hot keys, invariants, files and streams."""

from __future__ import annotations

import gzip
import json
import random
import time
import zipfile
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quernstone.operators import identity as I
from quernstone.operators import records as R
from quernstone.operators import scratch, skew
from quernstone.sources import files
from quernstone.streaming import arrivals


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_shared_folder_is_taken_from_the_session(spark):
    class Named:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: {"spark.checkpoint.dir": "hdfs://shared/x/"}.get(key, default))})

    assert scratch.shared_folder(Named()) == "hdfs://shared/x"
    saved = scratch.Scratch(spark, "t").save(spark.range(3).toDF("x"))
    assert got(saved) == [(0,), (1,), (2,)] and "/t-" in saved._quernstone_path


class TestSkew:
    SCHEMA = "k string, v int, at int, id int"

    def test_state(self, spark):
        df = spark.createDataFrame([("a", 1, 5, 1), ("a", None, 5, 2), ("a", 2, None, 3), (None, 4, 1, 4)], self.SCHEMA)
        found = skew.per_key_state(df, "k", {"total": F.col("v")}, latest_by=("at", "id"), latest=("id",))
        assert got(found) == [("a", 3, 3, 2), (None, 1, 4, 4)]
        assert got(skew.per_key_state(df.limit(0), "k", {"total": F.col("v")})) == []

    def test_heavy_keys(self, spark):
        df = spark.createDataFrame([("a",)] * 10 + [("b",)] * 5 + [("c",)] * 4 + [(None,)] * 81, "k string")
        assert got(skew.heavy_keys(df, "k", 0.05)) == [("a",), ("b",)]
        assert got(skew.heavy_keys(df.limit(0), "k", 0.05)) == []

    def test_partial_states_are_made_before_the_shuffle(self, spark):
        df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").cast("int").alias("v"))
        plan = skew.per_key_state(df, "k", {"total": F.col("v")}, latest_by=("v",), latest=("v",))._jdf.queryExecution().executedPlan().toString()
        assert plan.index("partial_sum") > plan.index("Exchange hashpartitioning")

    def test_hot_join(self, spark):
        facts = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(500)] + [(None, 1)], "k string, v int")
        lookup = spark.createDataFrame([("hot", "H")] + [(f"k{i}", "C") for i in range(0, 500, 2)], "k string, w string")
        counts = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"))
        found = skew.hot_aware_join(facts, lookup, "k", counts, 1000, least_hot=5)
        assert got(found.select("k", "v", "w")) == got(skew.hot_aware_join(facts, lookup, "k", counts, 1000).select("k", "v", "w"))
        assert found.groupBy("w").count().orderBy("w").collect() == [("C", 250), ("H", 500)]


class TestRecords:
    def test_best_and_last(self, spark):
        df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), (None, 9, "n"), ("b", None, "q")], "k string, s int, t string")
        assert got(R.last_wins(df, "k", "s")) == [("a", 3, "y"), ("b", None, "q")]
        assert got(R.best_per_key(df, F.col("k"), F.col("t"))) == [("a", 1, "x"), ("b", None, "q"), (None, 9, "n")]

    def test_dedupe_is_idempotent(self, spark):
        df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, s int")
        once = R.last_wins(df, "k", "s")
        assert got(once) == got(R.last_wins(once, "k", "s"))

    def test_merge(self, spark):
        old = spark.createDataFrame([("a", 1, "o"), ("b", 2, "o")], "k string, v int, w string")
        new = spark.createDataFrame([("a", None, "n"), ("c", 3, "n")], "k string, v int, x string")
        assert got(R.merged(old, new, "k")) == [("a", 1, "o", "n"), ("b", 2, "o", None), ("c", 3, None, "n")]

    def test_pending(self, spark):
        wanted, done = spark.createDataFrame([("a",), ("b",), (None,)], "k string"), spark.createDataFrame([("a",), ("a",), (None,)], "k string")
        assert got(R.pending(wanted, done, "k")) == [("b",), (None,)]

    def test_lookup_takes_the_first_form(self, spark):
        probes = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"]), (3, ["y", "x"])], "id int, forms array<string>")
        stored = spark.createDataFrame([("x", "X"), ("y", "Y")], "u string, w string")
        assert got(R.ranked_lookup(probes, "id", F.col("forms"), stored, "u", ["w"])) == [(1, 0, "x", "X"), (3, 0, "y", "Y")]

    def test_siblings(self, spark):
        df = spark.createDataFrame([("g", x) for x in "abcde"] + [("h", "z"), (None, "q")], "g string, i string")
        found = {}
        for g, i, s, p in got(R.siblings(df, "g", "i", 2)):
            found.setdefault((g, i), []).append((p, s))
        assert found == {("g", "a"): [(1, "b"), (2, "c")], ("g", "b"): [(1, "a"), (2, "c")], **{("g", x): [(1, "a"), (2, "b")] for x in "cde"}}

    def test_sample_fills_its_plan(self, spark):
        df = spark.createDataFrame([("a" if i < 61 else "b" if i < 90 else None, i) for i in range(100)], "s string, i int")
        found = got(R.stratified_sample(df, "s", "i", 20, 1))
        assert len(found) == 20 and sum(s == "a" for s, _ in found) == 12
        assert len(got(R.stratified_sample(df, "s", "i", 500, 1))) == 100

    def test_assignment_is_balanced(self, spark):
        found = got(R.balanced_assignment(spark.range(200).toDF("i"), "i", list("abcdef"), 3, 42))
        per = {}
        for _, w in found:
            per[w] = per.get(w, 0) + 1
        assert per == dict.fromkeys("abcdef", 100) and len(set(found)) == 600

    def test_reports(self, spark):
        df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",)] + [(None,)], "k string")
        assert got(R.top_and_other(df, "k", 2)) == [("Other", 2), ("a", 3), ("b", 2)]
        assert got(R.completeness(df)) == [("k", 6, 7)]
        a, b = spark.createDataFrame([(1, "x"), (2, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (3, "y")], "k int, v string")
        assert got(R.changes(a, b, "k", "v")) == [("x", "y", 1), ("x", None, 1), (None, "y", 1)]


class TestIdentity:
    def buckets(self, spark):
        rows = [(f"r{i:02d}", ["hot"]) for i in range(11)] + [("a", ["v", None, ""]), ("b", ["v", "w"]), ("c", ["w"]), ("d", ["alone"])]
        return I.buckets(spark.createDataFrame(rows, "i string, x array<string>"), "i", {"mail": F.col("x")})

    def test_cap_and_edges(self, spark):
        capped = I.capped(self.buckets(spark))
        assert {v for _, v, _ in got(capped)} == {"v", "w"}
        assert got(I.pair_edges(capped)) == [("a", "b", 1, "mail"), ("b", "c", 1, "mail")]
        assert {i for i, *_ in got(I.shared_with_others(capped))} == {"a", "b", "c"}

    def test_cap_counts_records(self, spark):
        assert {v for _, v, _ in got(I.capped(self.buckets(spark), 11))} == {"hot", "v", "w"}

    def test_components_against_union_find(self, spark):
        rng = random.Random(1)
        pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
        parent = list(range(300))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        nodes = sorted({x for a, b in pairs if a != b for x in (a, b)})
        assert got(I.components(spark.createDataFrame(pairs, "src int, dst int"))) == sorted(((n, root(n)) for n in nodes), key=repr)

    def test_no_edges(self, spark):
        assert got(I.components(spark.createDataFrame([], "src string, dst string"))) == []
        assert got(I.communities(spark.createDataFrame([], "src string, dst string, weight long"))) == []

    def test_communities_stay_inside_components(self, spark):
        cliques = [(f"{g}{a}", f"{g}{b}", 1) for g in "xy" for a, b in combinations(range(5), 2)]
        edges = spark.createDataFrame([*cliques, ("x0", "y0", 1), ("z0", "z1", 1)], "src string, dst string, weight long")
        found = dict(got(I.communities(edges)))
        assert {frozenset(n for n in found if found[n] == c) for c in set(found.values())} == {frozenset(f"{g}{i}" for i in range(5)) for g in "xy"} | {frozenset(["z0", "z1"])}

    def test_large_components_are_divided_too(self, spark, monkeypatch):
        monkeypatch.setattr(I, "MOST_EDGES", 5)
        cliques = [(f"{g}{a}", f"{g}{b}", 2) for g in "xy" for a, b in combinations(range(5), 2)]
        edges = spark.createDataFrame([*cliques, ("x0", "y0", 1), ("z0", "z1", 1)], "src string, dst string, weight long")
        found = dict(got(I.communities(edges)))
        assert set(found) == {f"{g}{i}" for g in "xy" for i in range(5)} | {"z0", "z1"}
        assert len({found[f"x{i}"] for i in range(5)}) == len({found[f"y{i}"] for i in range(5)}) == 1 and found["z0"] == found["z1"] == "z0"

    def test_communities_of_a_ring_of_cliques_merge(self, spark):
        n = 40
        ring = [(3 * i + a, 3 * i + b, 1) for i in range(n) for a, b in combinations(range(3), 2)]
        ring += [(3 * i + 2, 3 * ((i + 1) % n), 1) for i in range(n)]
        found = dict(got(I.communities(spark.createDataFrame(ring, "src int, dst int, weight long"))))
        total = 2 * len(ring)
        mass: dict = {}
        for a, b, _ in ring:
            for x in (a, b):
                mass[found[x]] = mass.get(found[x], 0) + 1
        modularity = sum(found[a] == found[b] for a, b, _ in ring) / len(ring) - sum(m * m for m in mass.values()) / total**2
        # One clique a community has 0.725, two cliques a community 0.825.
        assert modularity >= 0.825

    def test_mean_cosine_against_pairs(self, spark):
        rng = random.Random(2)
        rows = [(g, [rng.gauss(0, 1) for _ in range(4)]) for g in (1, 1, 1, 2, 2, 3)]
        unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
        found = {g: c for g, _, c in got(I.mean_cosine(spark.createDataFrame(rows, "g int, v array<float>"), "g", "v", 4))}
        for g in (1, 2):
            own = [unit(v) for k, v in rows if k == g]
            pairs = [sum(a * b for a, b in zip(x, y)) for x, y in combinations(own, 2)]
            assert found[g] == pytest.approx(sum(pairs) / len(pairs), abs=1e-6)
        assert set(found) == {1, 2}


class TestFiles:
    def test_csv(self, spark, tmp_path):
        with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
            f.write('url,v\na,"one\nline"\nb,2\na,3\n')
        assert got(files.read_csv(spark, str(tmp_path / "a.csv.gz"), "url string, v string", "v")) == [("2",), ("3",), ("one\nline",)]
        assert got(files.read_csv_index(spark, str(tmp_path / "a.csv.gz"), "url string, v string", "url")) == [("a", "3"), ("b", "2")]
        assert got(files.read_csv_index(spark, str(tmp_path / "none.csv"), "url string", "url")) == []

    def test_json_lines_and_lists(self, spark, tmp_path):
        (tmp_path / "a.jsonl").write_text('{"url": "a", "n": 1}\nbroken\n{"url": "b"}\n')
        assert got(files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "url string, n int")) == [("a", 1), ("b", None)]
        (tmp_path / "l.txt").write_text("# note\n b \n\na\n")
        assert got(files.read_list(spark, str(tmp_path / "l.txt"))) == [("a",), ("b",)]

    def test_zip(self, spark, tmp_path):
        with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
            z.writestr("one.json", json.dumps([{"u": "a"}, {"u": "b"}]))
            z.writestr("progress.json", json.dumps({"u": "no"}))
            z.writestr("two.json", "{")
        assert got(files.read_zipped_json(spark, str(tmp_path / "x.zip"), "u string")) == [("a",), ("b",)]

    def test_sinks(self, spark, tmp_path):
        df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 2)], "k string, v int")
        files.write_list(df, "k", str(tmp_path / "list"))
        assert [r.value for r in spark.read.text(str(tmp_path / "list")).collect()] == ["a", "b"]
        files.append_jsonl(df, str(tmp_path / "log"))
        files.append_jsonl(df, str(tmp_path / "log"))
        assert files.read_jsonl(spark, str(tmp_path / "log"), "k string, v int").count() == 6
        files.write_csv(df, str(tmp_path / "csv"), ["v", "k"])
        assert got(files.read_csv(spark, str(tmp_path / "csv"), "v int, k string")) == [(1, "b"), (2, "a"), (2, "a")]
        assert got(files.stage_counts({"all": df, "none": df.limit(0)})) == [("all", 3), ("none", 0)]

    def test_swap_keeps_the_first_version(self, spark, tmp_path):
        path, backup = str(tmp_path / "t"), str(tmp_path / "t0")
        spark.range(1).write.parquet(path)
        for n in (2, 3):
            files.swapped_in(spark.read.parquet(path).unionByName(spark.range(n)), path, backup)
        assert spark.read.parquet(path).count() == 6 and spark.read.parquet(backup).count() == 1

    def test_nested_paths(self, spark):
        df = spark.createDataFrame([(1, (2, 3))], "a int, s struct<x:int,y:int>")
        row = files.with_paths(df, {"s.x": F.lit(9), "n.m.o": F.lit(1), "a": F.lit(5)}).first().asDict(True)
        assert row == {"a": 5, "s": {"x": 9, "y": 3}, "n": {"m": {"o": 1}}}


class TestStreams:
    def test_drained(self, spark, tmp_path):
        rows = spark.createDataFrame([(i % 5, f"2024-01-01 00:0{i % 10}:00", float(i)) for i in range(20)], "k int, t string, v double").select("k", F.to_timestamp("t").alias("t"), "v")
        rows.repartition(3).write.parquet(str(tmp_path / "in"))
        stream = lambda: arrivals.stream_of(spark, str(tmp_path / "in"), rows.schema)
        assert got(arrivals.drained(arrivals.first_arrivals(stream(), "k", "t").select("k"))) == [(i,) for i in range(5)]
        found = arrivals.drained(arrivals.rates(stream(), "k", "t", "v"), "complete")
        assert found.agg(F.sum("n_events"), F.sum("total")).first() == (20, 190.0)


class TestFuzzy:
    def test_similar_names_against_all_pairs(self, spark):
        from quernstone.functions.vectorized import indel_ratio, sorted_tokens
        from quernstone.operators import fuzzy

        rng = random.Random(4)
        names = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(4, 24))).strip() for _ in range(120)]
        for n in list(names):
            at = rng.randrange(len(n) + 1)
            names.append(n[:at] + rng.choice("abcdx") + n[at + rng.randrange(2) :])
        names = sorted({n.strip() for n in names if n.strip()})
        wanted = {(a, b) for a, b in combinations(names, 2) if indel_ratio(sorted_tokens(a), sorted_tokens(b)) >= 85}
        found = {(a, b) for a, b, _ in got(fuzzy.similar_names(spark.createDataFrame([(n,) for n in [*names, None, " "]], "n string"), "n", 85.0))}
        assert found == wanted and len(wanted) > 50

    def test_names_sharing_a_word_meet_by_more_than_it(self, spark):
        import pyarrow as pa

        from quernstone.functions.vectorized import indel_ratio, sorted_tokens
        from quernstone.operators import fuzzy

        rng = random.Random(5)
        names = {"Guadalupe " + "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).title() for _ in range(400)}
        names |= {n[:at] + n[at + 1 :] for n in list(names)[:60] for at in (11, 14)} | {" ".join(reversed(n.split())) for n in list(names)[:30]}
        names = sorted(names)
        wanted = {(a, b) for a, b in combinations(names, 2) if indel_ratio(sorted_tokens(a), sorted_tokens(b)) >= 90}
        rows = got(fuzzy.similar_names(spark.createDataFrame([(n,) for n in names], "n string"), "n"))
        assert {(a, b) for a, b, _ in rows} == wanted and len(rows) == len(wanted) > 150
        assert all(r == indel_ratio(sorted_tokens(a), sorted_tokens(b)) for a, b, r in rows)
        # Parts of names put all of these into one block.
        counts = list(Counter(map(ord, "".join(sorted_tokens(n) for n in names))).items())
        keys = [k for batch in fuzzy._group_keys(counts, 90.0)(iter([pa.RecordBatch.from_arrays([pa.array(names)], names=["name"])])) for k in batch.column(0).to_pylist()]
        assert max(Counter(keys).values()) < len(names) / 5 and sum(n * (n - 1) // 2 for n in Counter(keys).values()) < 0.2 * len(names) ** 2 / 2

    def test_long_names_and_odd_characters(self, spark):
        from quernstone.functions.vectorized import indel_ratio, sorted_tokens
        from quernstone.operators import fuzzy

        rng = random.Random(6)
        names = ["".join(rng.choice("abcdefghijklmnopqrst\u00e9\u4e2d\U0001f600") for _ in range(n)) for n in (10, 30, 62, 63, 64, 65, 90, 125, 126, 140) for _ in range(2)]
        for n in list(names):
            for edits in (1, len(n) // 25, len(n) // 11, len(n) // 9):
                x = list(n)
                for at in rng.sample(range(len(n)), edits):
                    x[at] = rng.choice(["", "u", x[at] + "v"])
                names.append("".join(x))
        names = sorted({*names, "a\tb", "b a", "\t", "\n"})
        wanted = {(a, b) for a, b in combinations(names, 2) if a.strip() and b.strip() and indel_ratio(sorted_tokens(a), sorted_tokens(b)) >= 90}
        found = got(fuzzy.similar_names(spark.createDataFrame([(n,) for n in names], "n string"), "n"))
        assert {(a, b) for a, b, _ in found} == wanted and len(found) == len(wanted) and sum(len(a) > 130 for a, _ in wanted) > 5

    def test_legacy_clusters_of_many_names_with_one_given_name(self, spark, tmp_path):
        from quernstone.functions.vectorized import sorted_tokens
        from quernstone.plans import upkeep

        rng = random.Random(7)
        names = sorted({"Guadalupe " + "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).title() for _ in range(6000)})
        spark.createDataFrame([(f"u{i}", n) for i, n in enumerate(names)], "url string, organizer string").write.parquet(str(tmp_path / "campaigns.parquet"))
        contacts = [(f"u{i}", [f"box{i // 2}@host.example.org"], None, None, None) for i in range(40)]
        spark.createDataFrame(contacts, "url string, emails array<string>, phones array<string>, payment_handles array<string>, urls array<string>").write.parquet(str(tmp_path / "contacts.parquet"))
        # Of two names of 18 letters 90 % are the same if they are equal but for one letter each.
        over: dict[str, str] = {n: n for n in names}

        def root(n: str) -> str:
            while over[n] != n:
                n = over[n]
            return n

        ties = {(names[i], names[i + 1]) for i in range(0, 40, 2)}
        holders: dict[str, str] = {}
        for n in names:
            text = sorted_tokens(n)
            ties |= {(holders.setdefault(text[:at] + text[at + 1 :], n), n) for at in range(len(text))}
        ties = {(a, b) for a, b in ties if a != b}
        for a, b in ties:
            a, b = sorted((root(a), root(b)))
            over[b] = a
        began = time.time()
        found = got(upkeep.legacy_clusters(spark, str(tmp_path)))
        assert found == sorted((n, root(n)) for n in {n for tie in ties for n in tie})
        # All 18 million pairs of these names shared a part and were compared.
        assert time.time() - began < 75

    def test_linked_names_connect_what_pairs_connect(self, spark, monkeypatch):
        from quernstone.operators import fuzzy

        rng = random.Random(8)
        names = {f"{g} {''.join(rng.choice('bdfgklmnprstvz') + rng.choice('aeiou') for _ in range(4)).title()}" for g in ("Guadalupe", "Ursula") for _ in range(120)}
        # Copies that are nearly all alike, chains, the same words in another order, texts of more than 63 characters and some that meet by parts.
        names |= {f"{n} {k:02d}" for n in sorted(names)[:4] for k in range(60)} | {n[:at] + n[at + 1 :] for n in sorted(names)[:40] for at in (2, 12)} | {" ".join(reversed(n.split())) for n in sorted(names)[:9]}
        names |= {x[:at] + "x" + x[at + 2 :] for x in ("".join(rng.choice("abcdefghijklm\u4e2d\U0001f600") for _ in range(n)) for n in (62, 64, 90, 140)) for at in (0, 9, 17, 30)}
        df = spark.createDataFrame([(n,) for n in [*sorted(names), None, " "]], "n string")
        pairs = fuzzy.similar_names(df, "n").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        wanted = got(I.components(pairs))
        links = fuzzy.linked_names(df, "n").persist()
        assert got(I.joined(links)) == wanted and len(wanted) > 300
        # Every pair was made and sent on: copies of one name grow with the square of their number.
        assert pairs.count() > 4000 and links.count() < 4 * len(names) < 3000
        monkeypatch.setattr(I, "MOST_JOINED", 400)
        assert got(I.joined(pairs)) == wanted
        monkeypatch.setattr(I, "MOST_JOINED", 100)
        assert got(I.joined(pairs)) == wanted
        assert got(I.joined(pairs.limit(0))) == []

    def test_legacy_clusters_of_shared_values(self, spark, tmp_path):
        from quernstone.plans import upkeep

        names = ["Xo Quabide", "Ufa Merrylin", "Jeb Tonkawa", "Zig Holvard", "Ann Corpuzi", "Pim Esterel"]
        # u0 has two names, of which the least counts; u3 has none; u9 is no campaign; eleven pages share a value that counts for none of them.
        pages = [("u0", names[0]), ("u0", names[1]), ("u1", names[2]), ("u2", f" {names[3]} "), ("u3", None), ("u3", " "), ("u4", names[4]), ("u5", names[5]), (None, names[5])] + [(f"v{i}", f"{chr(97 + i) * 7} {chr(107 + i) * 9}") for i in range(11)]
        spark.createDataFrame(pages, "url string, organizer string").write.parquet(str(tmp_path / "campaigns.parquet"))
        mail = {"u0": ["a@one.example"], "u1": ["a@one.example"], "u2": ["b@one.example"], "u3": ["b@one.example", "a@one.example", "c@one.example"], "u4": ["c@one.example"], "u5": ["d@one.example"], "u9": ["d@one.example"]} | {f"v{i}": ["e@one.example"] for i in range(11)}
        spark.createDataFrame([(u, e, None, None, None) for u, e in mail.items()], "url string, emails array<string>, phones array<string>, payment_handles array<string>, urls array<string>").write.parquet(str(tmp_path / "contacts.parquet"))
        assert got(upkeep.legacy_clusters(spark, str(tmp_path))) == [(names[2], names[2]), (names[1], names[2])]

    def test_nearest_word(self, spark):
        from quernstone.operators import fuzzy

        df = spark.createDataFrame([(1, "call 12345 or write to 99999 now"), (2, None), (3, "77777")], "i int, t string")
        found = got(fuzzy.nearest_word(df, "i", F.col("t"), r"\d{5}", {"c": "call", "w": "write"}, 15))
        assert found == [(1, 0, "12345", "c", 1), (1, 1, "99999", "w", 4), (3, 0, "77777", None, None)]


def test_checksums_and_literals(spark):
    from quernstone.functions import vectorized as V

    cases = {
        "1BoatSLRHtKNngkdXEeobR76b53LETtpyT": "bitcoin", "1BoatSLRHtKNngkdXEeobR76b53LETtpyU": None, "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4": "bitcoin", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5": None,
        "GB82WEST12345698765432": "iban", "GB82WEST12345698765433": None, "0x" + "ab" * 20: "ethereum", "0x12": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "h string").select("h", V.checksum_kind("h").alias("k"))
    assert {r.h: r.k for r in df.collect()} == cases
    texts = ["{'a': [1, None]}", '{"a": 1}', "plain", "{broken", None]
    found = [r.j for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", V.literal_json("t").alias("j")).orderBy("i").collect()]
    assert found == ['{"a": [1, null]}', '{"a": 1}', '"plain"', '"{broken"', None]
    folded = spark.createDataFrame([("Dr.  Jözé O'Neil-Ça",), (None,)], "t string").select(V.ascii_folded("t").alias("f")).collect()
    assert [r.f for r in folded] == ["dr joze o'neil-ca", None]


def test_social_and_kinds(spark):
    from quernstone.functions import markup as M
    from quernstone.functions import social as S
    from quernstone.operators import handles as H

    urls = ["https://www.facebook.com/Some.One?x=1", "m.facebook.com/abc", "https://t.me/@chan", "@Bare_one", "https://linkedin.com/in/joe-d/", "https://facebook.com/", "example.com/x", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    found = [(r.platform, r.user_id) for r in H.parsed_handles(df, "u").orderBy("i").collect()]
    assert found == [("facebook", "Some.One"), ("unknown", "abc"), ("telegram", "chan"), ("unknown", "Bare_one"), ("linkedin", "in/joe-d"), (None, None), (None, None), (None, None)]
    kinds = [r.k for r in df.select("i", S.url_kind(F.col("u"), ["example.com"]).alias("k")).orderBy("i").collect()]
    assert kinds[0] == "social" and kinds[6] == "own" and kinds[7] is None
    times = ["2023-01-02T03:04:05Z", "2023-01-02T03:04:05+01:00", "2023-01-02", "31/12/2022", "12/31/2022", "x", None]
    stamps = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string").select("i", F.date_format(S.parsed_time(F.col("t")), "yyyy-MM-dd HH:mm").alias("s")).orderBy("i").collect()]
    assert stamps == ["2023-01-02 03:04", "2023-01-02 02:04", "2023-01-02 00:00", "2022-12-31 00:00", "2022-12-31 00:00", None, None]
    (row,) = spark.createDataFrame([("US$1,911.00 raised of $8,000.00 goal, 18 Donors",)], "t string").select(M.widget_amounts(F.col("t")).alias("w")).select("w.*").collect()
    assert tuple(row) == (8000.0, 1911.0, "USD", 18)
    phones = spark.createDataFrame([("+44 20 7946 0000",), ("0044 20 7946 0000",), ("(0)555-010-0100",), ("12",)], "p string").select(S.international(F.col("p"), F.lit("1")).alias("e")).collect()
    assert [r.e for r in phones] == ["+442079460000", "+442079460000", "+15550100100", None]


def test_nested(spark):
    from quernstone.functions import nested as N

    df = spark.createDataFrame([(["Ann", "ann ", "Bo", ""], ["bo", "Cy"], "Ann met Cy", float("nan"))], "a array<string>, b array<string>, t string, x double")
    row = df.select(
        N.found_in(F.col("a"), F.col("t")).alias("found"),
        N.united(F.col("a"), F.col("b"), lambda x: F.lower(F.trim(x))).alias("united"),
        N.parted(F.col("a"), lambda x: F.length(x) > 2).alias("parted"),
        N.appended_once(F.col("b"), F.lit("Cy")).alias("same"),
        N.appended_once(F.lit(None).cast("array<string>"), F.lit("p")).alias("new"),
        N.boilerplate(F.lit(" Powered by us"), ["powered by"]).alias("boiler"),
        N.contains_any(F.col("t"), ["REDACTED", "met"]).alias("marked"),
        N.scrubbed(F.col("x")).alias("scrubbed"),
        N.humanized(F.lit("two_words"), {"a": "b"}).alias("human"),
        N.sentence((F.lit(True), F.lit("one")), (F.lit(False), F.lit("two")), (F.lit(True), F.lit("three"))).alias("sentence"),
    ).first()
    assert row.found == ["Ann", "ann "] and row.united == ["Ann", "Bo", "", "Cy"]
    assert tuple(row.parted) == (["Ann", "ann "], ["Bo", ""]) and row.same == ["bo", "Cy"] and row.new == ["p"]
    assert row.boiler and row.marked and row.scrubbed is None and row.human == "two words" and row.sentence == "one, three."


class TestEnrichment:
    SCHEMA = "url string, ok boolean, ms int, err string, size int"

    @staticmethod
    def client():
        def call(text):
            if "bad" in text:
                raise ValueError("no")
            return {"size": len(text)}

        return call

    def test_failures_are_rows(self, spark):
        from quernstone.operators import enrich

        df = spark.createDataFrame([("a", "abc"), ("b", "bad"), ("c", None)], "url string, t string").coalesce(1)
        found = enrich.enriched(df, "url", "t", self.client, "size int", pauses=(0.0,)).select("url", "ok", "err", "size")
        assert got(found) == [("a", True, None, 3), ("b", False, "ValueError: no", None)]

    def test_dead_client_is_not_asked_for_ever(self, spark):
        from quernstone.operators import enrich

        df = spark.createDataFrame([(str(i), "bad") for i in range(9)], "url string, t string").coalesce(1)
        errors = [r.err for r in enrich.enriched(df, "url", "t", self.client, "size int", pauses=(), most_failures=3).collect()]
        assert errors.count("ValueError: no") == 3 and len(errors) == 9

    def test_pauses(self):
        from quernstone.operators import enrich

        slept = []
        assert enrich.attempted(self.client(), "bad", (1.0, 5.0), slept.append) == ({}, "ValueError: no") and slept == [1.0, 5.0]

    def test_resumption(self, spark, tmp_path):
        from quernstone.operators import enrich

        path = str(tmp_path / "log")
        df = spark.createDataFrame([("a", "abc"), ("b", "bad")], "url string, t string")
        ask = lambda: enrich.resumed(df, "url", "t", path, self.SCHEMA, self.client, "size int", pauses=())
        assert [ask(), ask()] == [2, 1]
        assert files.read_jsonl(spark, path, self.SCHEMA).where("ok").count() == 1


def test_contexts_and_snippets(spark):
    from quernstone.functions import markup as M

    df = spark.createDataFrame([(1, "ab x@y.org, x@y.org end", "END"), (2, None, "a"), (3, "", ""), (4, "none here", "zz")], "i int, t string, w string")
    found = [[tuple(c) for c in r.c] for r in df.select("i", M.contexts(F.col("t"), M.EMAIL, 3, 2).alias("c")).orderBy("i").collect()]
    assert found == [[("x@y.org", 4, "ab x@y.org, "), ("x@y.org", 13, "g, x@y.org e")], [], [], []]
    assert [r.s for r in df.select("i", M.snippet(F.col("t"), F.col("w"), 4).alias("s")).orderBy("i").collect()] == ["org end", "", "", ""]


def test_page_text(spark):
    from quernstone.functions import markup as M

    pages = ["<body><main>A <b>b</b></main></body>", "<meta property='og:description' content='Own'>", "", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string")
    assert [r.d for r in df.select("i", M.page_description(F.col("p")).alias("d")).orderBy("i").collect()] == ["A b", "Own", "", ""]


def test_handles_of_nothing_and_repeats(spark):
    from quernstone.operators import handles as H

    df = spark.createDataFrame([(None, 1), ("@jo", 2), ("@jo", 2)], "h string, extra int")
    assert sorted((r.extra, r.user_id, r.drop_reason) for r in H.parsed_handles(df, "h").collect()) == [(1, None, "empty"), (2, "jo", None), (2, "jo", None)]
    assert H.parsed_handles(df.limit(0), "h").count() == 0
    assert {r.action for r in H.reclassified_handles(H.parsed_handles(df, "h")).collect()} == {"no_change"}
    links = H.classified_links(spark.createDataFrame([("https://m.facebook.com/jo",), ("x",), (None,)], "u string"), "u").collect()
    assert [(r.kind, r.platform, r.user_id) for r in links] == [("social_handle", "facebook", "jo"), (None, None, None), (None, None, None)]


def test_backup_is_made_once_and_restored(spark):
    from quernstone.operators import records as R

    df = spark.createDataFrame([(1, "ab"), (2, None)], "i int, x string")
    twice = R.rewritten(R.rewritten(df, "x", lambda c: F.upper(c)), "x", lambda c: F.concat(c, c))
    assert sorted(map(tuple, twice.collect())) == [(1, "ABAB", "ab"), (2, None, None)]
    assert sorted(map(tuple, R.restored(twice, "x").collect())) == [(1, "ab"), (2, None)]
    assert R.restored(df, "x").columns == ["i", "x"]


def test_nested_record_and_hot_side_join(spark):
    from quernstone.operators import records as R

    base = spark.createDataFrame([(1,), (2,)], "k int")
    part = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (9, "z")], "k int, v string")
    assert [(r.k, [p.v for p in r.parts]) for r in R.nested_record(base, "k", {"parts": part}).orderBy("k").collect()] == [(1, ["a", "a", "b"]), (2, [])]
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "x")], "i int, k string")
    lookup = spark.createDataFrame([("a", 7)], "k string, n int")
    assert sorted((r.i, r.n) for r in R.hot_side_join(rows, lookup, "k").collect()) == [(1, 7), (2, None), (3, None)]
