"""Nulls, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quernstone.llm import components, language, leakage, names, packing, pii, sentences, sketchjoin, urlcopies

# Names that the operators use inside.
CLASH = "rep long, id2 long, key string, tie string, v long, l long, bucket string, entity string, shard long"
EXTRA = (1, 2, "k", "t", 3, 4, "b", "e", 5)


def rows(spark, schema, data):
    return spark.createDataFrame([(*r, *EXTRA) for r in data], f"{schema}, {CLASH}")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


LONG = " ".join(f"word{i} goes on and on." for i in range(20_000))


class TestNames:
    def run(self, spark, data):
        return got(names.spelling_pairs(rows(spark, "organizer string", data), "organizer"))

    def test_empty_and_nulls(self, spark):
        assert self.run(spark, []) == []
        assert self.run(spark, [(None,), ("",), ("  ",), ("N/A",), ("Campaign Team",), ("!!",)]) == []

    def test_repeated_rows_and_long_text(self, spark):
        assert self.run(spark, [("Ann Lee",), ("Ann Lee",), ("x" * 50_000,), (LONG,)]) == []
        assert self.run(spark, [("Anna Leeworth",), ("Leeworth, Anna",), ("Leeworth, Anna",)]) == [("Anna Leeworth", "Leeworth, Anna")]


class TestSketch:
    def run(self, spark, data, **options):
        return got(sketchjoin.near_duplicate_pairs(rows(spark, "id long, t string", data), "id", F.col("t"), **options))

    def test_empty_nulls_short(self, spark):
        assert self.run(spark, []) == []
        assert self.run(spark, [(1, None), (2, None), (None, "a b c d e f"), (3, ""), (4, "one two")]) == []

    def test_copies_and_repeats(self, spark):
        text = " ".join(f"w{i}" for i in range(60))
        assert self.run(spark, [(1, text), (1, text), (2, text), (3, text.upper())]) == [(1, 2), (1, 3), (2, 3)]

    def test_long_texts(self, spark):
        assert self.run(spark, [(1, LONG), (2, LONG + " the end comes now at last")]) == [(1, 2)]

    def test_groups_keep_every_record(self, spark):
        text = " ".join(f"w{i}" for i in range(60))
        found = got(sketchjoin.near_duplicate_groups(rows(spark, "id long, t string", [(1, text), (2, text), (3, text + " x y"), (4, "a b c d e f g")]), "id", F.col("t")))
        assert found == [(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 4, 0)]


class TestCopies:
    def run(self, spark, data, **options):
        df = rows(spark, "id long, url string", data)
        return got(urlcopies.formatting_copies(df, "id", urlcopies.canonical_url(F.col("url")), **options))

    def test_empty_nulls(self, spark):
        assert self.run(spark, []) == []
        assert self.run(spark, [(1, None), (None, "http://a.example/x"), (2, ""), (3, " <> ")]) == []

    def test_repeats_and_long(self, spark):
        long = "http://a.example/" + "x" * 100_000
        assert self.run(spark, [(1, "http://a.example/b"), (1, "http://a.example/b"), (5, long), (6, long + "/")]) == [(1, 1), (1, 1), (5, 5), (5, 6)]

    def test_hot_text_and_split_buckets(self, spark):
        data = [(i, f"https://a.example/campaign/{'hot' if i % 3 == 0 else i}") for i in range(300)]
        found = self.run(spark, data, least_bucket=10)
        assert len(found) == 300
        assert [x for x in found if x[0] != x[1]] == sorted([(0, i) for i in range(3, 300, 3)], key=repr)

    def test_page_counts(self, spark):
        df = rows(spark, "id long, url string", [(2, "http://a.example/b"), (1, "A.example/b/"), (3, "a.example/c")])
        assert got(urlcopies.page_counts(df, "id", "url")) == [(1, "A.example/b/", 2), (3, "a.example/c", 1)]


class TestGroups:
    def run(self, spark, data):
        return got(components.connected_groups(rows(spark, "item string, cluster string", data), "item", "cluster"))

    def test_empty_nulls(self, spark):
        assert self.run(spark, []) == []
        assert self.run(spark, [(None, "1"), ("a", None)]) == [("a", "a", 1)]

    def test_chain_ties_repeats(self, spark):
        data = [(f"i{n:02d}", str(n // 2)) for n in range(1, 20)] + [(f"i{n:02d}", str((n + 1) // 2)) for n in range(1, 20)] * 2
        assert {(g, n) for _, g, n in self.run(spark, data)} == {("i01", 19)}

    def test_hot_tie(self, spark, monkeypatch):
        monkeypatch.setattr(components, "LEAST_HOT", 5)
        monkeypatch.setattr(components, "HOT_SHARE", 10)
        data = [(f"i{n:03d}", "hot") for n in range(120)] + [(f"j{n:03d}", f"c{n // 2}") for n in range(60)]
        found = self.run(spark, data)
        assert {(g, n) for i, g, n in found if i[0] == "i"} == {("i000", 120)}
        assert all(n == 2 for i, _, n in found if i[0] == "j")


class TestPii:
    def run(self, spark, data):
        return got(pii.personal_items(rows(spark, "id long, t string", data), "t", "id").select("id", "pii_kind", "pii_text"))

    def test_empty_nulls(self, spark):
        assert self.run(spark, []) == []
        assert self.run(spark, [(1, None), (2, ""), (3, LONG)]) == []

    def test_repeats(self, spark):
        assert self.run(spark, [(1, "Write to a.b@mail.example now."), (1, "Write to a.b@mail.example now.")]) == [(1, "email", "a.b@mail.example")] * 2

    def test_redaction_keeps_rows(self, spark):
        found = got(pii.redacted(rows(spark, "id long, t string", [(1, None), (2, ""), (3, "Call +1 542 555 0146 today.")]), "t", "id"))
        assert found == [(1, None), (2, ""), (3, "Call [PHONE] today.")]


class TestLanguage:
    @pytest.fixture(scope="class")
    def model(self):
        return language.fit([])

    def run(self, spark, data, model):
        return got(language.passages(rows(spark, "n long, t string", data), F.col("t"), model, "n").select("n", "seg_no", "lang"))

    def test_empty_nulls(self, spark, model):
        assert self.run(spark, [], model) == []
        assert self.run(spark, [(1, None), (2, ""), (3, "123 456")], model) == []

    def test_long_and_repeats(self, spark, model):
        assert self.run(spark, [(1, "they have been there with us for all of that. " * 5000)] * 2, model) == [(1, 1, "en")] * 2


class TestPacking:
    def run(self, spark, sizes, kinds):
        return packing.pack(rows(spark, "id long, n_tokens long", sizes), rows(spark, "container_kind string, capacity_tokens int", kinds))

    def test_empty(self, spark):
        assert self.run(spark, [], [("a", 10)]).count() == 0
        assert self.run(spark, [(1, 5)], []).count() == 0
        assert self.run(spark, [(None, 5)], [("a", 10), (None, 3), ("b", None)]).count() == 0

    def test_sizes_at_the_edge(self, spark):
        found = self.run(spark, [(1, 0), (2, 10), (3, 11), (4, 30), (5, None)], [("a", 10)]).collect()
        per = {}
        for r in found:
            per.setdefault(r.doc_id, []).append(r.n_tokens)
        assert {k: sum(v) for k, v in per.items()} == {1: 0, 2: 10, 3: 11, 4: 30, 5: 0}
        assert {k: len(v) for k, v in per.items()} == {1: 1, 2: 1, 3: 2, 4: 3, 5: 1}


class TestLeaks:
    def run(self, spark, docs, items, **options):
        return got(leakage.leaked_items(rows(spark, "doc_id long, text string", docs), "doc_id", "text", rows(spark, "item_id long, text string", items), "item_id", "text", **options))

    def test_empty_nulls(self, spark):
        twelve = " ".join(f"w{i}" for i in range(12))
        assert self.run(spark, [], [(1, twelve)]) == []
        assert self.run(spark, [(1, twelve)], []) == []
        assert self.run(spark, [(1, None), (None, twelve), (2, "")], [(1, twelve), (None, twelve), (2, None), (3, "short")]) == []

    def test_longest_match_with_its_place(self, spark):
        item = " ".join(f"w{i}" for i in range(30))
        docs = [(1, "intro here " + " ".join(f"W{i}," for i in range(5, 25))), (2, " ".join(f"w{i}" for i in range(11))), (1, "intro here " + " ".join(f"W{i}," for i in range(5, 25)))]
        assert self.run(spark, docs, [(7, item), (7, item)]) == [(1, 7, 20, 2, 5)]

    def test_blocks_of_items(self, spark):
        items = [(n, " ".join(f"x{n}y{i}" for i in range(15))) for n in range(9)]
        docs = [(n, f"before {t} after") for n, t in items]
        assert [(d, i) for d, i, *_ in self.run(spark, docs, items, block_chars=100)] == [(n, n) for n in range(9)]


class TestSentences:
    def run(self, spark, data):
        return got(sentences.sentences(rows(spark, "doc string, t string", data), "doc", "t").select("id", "sentence_no", "start_pos", "end_pos"))

    def test_empty_nulls(self, spark):
        assert self.run(spark, []) == []
        assert self.run(spark, [("a", None), (None, "One."), ("b", ""), ("c", " \n ")]) == []

    def test_repeats_and_private_use(self, spark):
        assert self.run(spark, [("a", " One. Two.")] * 2) == [("a", 1, 0, 6), ("a", 1, 0, 6), ("a", 2, 7, 11), ("a", 2, 7, 11)]

    def test_long(self, spark):
        assert len(self.run(spark, [("a", LONG)])) == 20_000
