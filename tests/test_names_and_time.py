import random
from datetime import date, datetime, timedelta
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.vectors import TrainedVectors
from ledgerloom.operators import asof, boilerplate, clusters, metrics, monitoring, suppliers
from ledgerloom.operators.components import connected_components


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def split_digits(name):
    return "".join(c for c in name if c.isdigit() and c.isascii()), "".join(c for c in name if not (c.isdigit() and c.isascii()))


def near_pairs(names, most):
    parts = {n: split_digits(n) for n in names}
    return {(a, b) for a in names for b in names if a < b and parts[a][0] == parts[b][0] and edit_distance(parts[a][1], parts[b][1]) <= most}


def made_names(seed, n=220):
    rng = random.Random(seed)
    roots = ["acme", "north wind trading", "ab", "a", "x1", "delta 7", "delta 8", "aaaaaaaa", "müller und sohn", "banana banana"]
    names = set(roots)
    while len(names) < n:
        name = list(rng.choice(roots))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(name))
            if rng.random() < 0.5 and at < len(name):
                name[at] = rng.choice("abcx ")
            elif name and rng.random() < 0.5:
                del name[min(at, len(name) - 1)]
            else:
                name.insert(at, rng.choice("abcx"))
        names.add("".join(name) or "q")
    return sorted(names)


@pytest.mark.parametrize(("most", "block"), [(1, 2000), (2, 2000), (2, 5)])
def test_close_names_are_all_found(spark, most, block):
    names = made_names(3)
    found = suppliers.name_links(spark.createDataFrame([(n,) for n in names], "name string"), most, block)
    assert {tuple(r) for r in found.collect()} == near_pairs(names, most)


def test_canonical_names(spark):
    rows = ["Acme Ltd", "ACME  ltd", "acme ltd", "acmee ltd", "acmeee ltd", "acmeeee ltdd", "Acme Ltd 2", "other", None, "", "  "]
    out = {r["name"]: (r["canonical"], r["n"], r["n_spellings"]) for r in suppliers.canonical_suppliers(spark.createDataFrame([(x,) for x in rows], "SUPPLIER string")).collect()}
    assert out == {
        "acme ltd": ("acme ltd", 3, 4), "acmee ltd": ("acme ltd", 1, 4), "acmeee ltd": ("acme ltd", 1, 4), "acmeeee ltdd": ("acme ltd", 1, 4),
        "acme ltd 2": ("acme ltd 2", 1, 1), "other": ("other", 1, 1), "": ("", 3, 1),
    }
    assert suppliers.canonical_suppliers(spark.createDataFrame([], "SUPPLIER string")).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(900, 901), (901, 902), (902, 900), (7, 7)]
    random.Random(1).shuffle(links)
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)} | {i: 900 for i in (900, 901, 902)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- confidences over time ----

CONFIDENCES = "ts timestamp, confidence map<string,double>"


def test_distances_by_hand(spark):
    day = datetime(2024, 1, 1)
    rows = [(day, {"nominal": 0.05}), (day, {"nominal": 0.95}), (day + timedelta(1), {"nominal": 1.0}), (day + timedelta(1), {"nominal": 0.97}),
            (day + timedelta(4), None), (day + timedelta(4), {"nominal": 2.0, "department": -1.0})]
    counts = monitoring.confidence_counts(spark.createDataFrame(rows, CONFIDENCES), "ts", "1 day", 10)
    out = {(r["window_start"].day, r["field"]): r for r in monitoring.distribution_distance(counts).collect()}
    assert len(out) == 9 and out[(1, "nominal")]["psi"] == 0 and out[(1, "nominal")]["ks"] == 0
    smooth = lambda n: (n + 0.5) / 7
    psi = sum((smooth(p) - smooth(q)) * log(smooth(p) / smooth(q)) for p, q in [(0, 1), (2, 1)])
    assert out[(2, "nominal")]["psi"] == pytest.approx(psi) and out[(2, "nominal")]["ks"] == pytest.approx(0.5)
    assert out[(2, "nominal")]["alert"] == (psi > 0.2)
    assert out[(5, "nominal")]["ks"] == pytest.approx(0.5) and out[(5, "department")]["psi"] == 0
    parts = [monitoring.confidence_counts(spark.createDataFrame(p, CONFIDENCES), "ts", "1 day", 10) for p in (rows[:3], rows[3:])]
    merged = monitoring.distribution_distance(parts[0].unionByName(parts[1]))
    assert sorted(map(str, merged.collect())) == sorted(map(str, out.values()))


def test_a_stream_keeps_what_the_table_gives_and_drops_late_rows(spark, tmp_path):
    rng = random.Random(2)
    start = datetime(2024, 3, 1)
    source, kept, state = (str(tmp_path / n) for n in ("source", "kept", "state"))

    def arrive(hours, n, name):
        rows = [(start + timedelta(hours=rng.uniform(*hours)), {"nominal": rng.random()}) for _ in range(n)]
        spark.createDataFrame(rows, CONFIDENCES).coalesce(1).write.parquet(f"{source}/{name}")
        return rows

    def run():
        stream = spark.readStream.schema(CONFIDENCES).option("recursiveFileLookup", True).parquet(source)
        query = monitoring.stream_confidence_counts(stream, "ts", kept, state, "1 day", watermark="12 hours")
        query.awaitTermination()
        return monitoring.late_rows(query)

    rows = arrive((0, 30), 80, "a")
    assert run() == 0
    rows += arrive((20, 70), 80, "b")  # the day before is still open
    assert run() == 0
    table = lambda: sorted(map(tuple, monitoring.kept_counts(spark, kept).collect()))
    batch = lambda rs: sorted(map(tuple, monitoring.confidence_counts(spark.createDataFrame(rs, CONFIDENCES), "ts", "1 day").collect()))
    assert table() == batch(rows)
    arrive((0, 5), 30, "late")  # the first day is closed
    more = arrive((71, 72), 5, "c")
    assert run() > 0
    assert table() == batch(rows + more)
    assert run() == 0 and table() == batch(rows + more)


# ---- words, vectors, clusters ----


def test_boilerplate_words(spark):
    rows = [("invoice for paper", "A"), ("invoice for ink", "B"), ("invoice for paper", "A"), ("invoice for ink", "B"), ("toner", None), (None, "A")]
    df = spark.createDataFrame(rows, "text string, label string")
    out = {r["term"]: r for r in boilerplate.term_label_entropy(df, "text", "label").collect()}
    assert out["invoice"]["df"] == 4 and out["invoice"]["entropy"] == pytest.approx(1.0) and out["paper"]["entropy"] == pytest.approx(0.0)
    whole = -(3 / 6 * log(3 / 6, 2) + 2 / 6 * log(2 / 6, 2) + 1 / 6 * log(1 / 6, 2))
    assert out["for"]["entropy_ratio"] == pytest.approx(1.0 / whole)
    terms = boilerplate.boilerplate_terms(df, "text", "label", 0.5, 0.6)
    assert {r["term"] for r in terms.collect()} == {"invoice", "for"}
    assert [r["stripped_text"] for r in boilerplate.strip_terms(df, "text", terms).collect()] == ["paper", "ink", "paper", "ink", "toner", ""]
    one = df.withColumn("label", F.lit("same"))
    assert {r["entropy_ratio"] for r in boilerplate.term_label_entropy(one, "text", "label").collect()} == {1.0}
    assert boilerplate.boilerplate_terms(df.limit(0), "text", "label").count() == 0


def test_trained_vectors_of_near_texts_are_nearer(spark):
    rng = random.Random(1)
    groups = [["paper", "ink", "pens", "folders", "staples"], ["bolt", "screw", "hammer", "drill", "wrench"]]
    texts = [(" ".join(rng.choices(g, k=6)),) for g in groups for _ in range(300)] + [("",), (None,), ("zzz unknown",)]
    df = spark.createDataFrame(texts, "text string")
    model = TrainedVectors.fit(df, "text", dim=16, rounds=5)
    again = TrainedVectors.fit(df.repartition(5), "text", dim=16, rounds=5)
    asked = spark.createDataFrame([("paper ink pens",), ("folders staples ink",), ("bolt drill wrench",), ("",), (None,), ("zzz",)], "text string")
    one, two = ([np.array(r["embedding"]) for r in m.transform(asked, "text").collect()] for m in (model, again))
    assert all(np.allclose(a, b) for a, b in zip(one, two, strict=True))
    assert [round(float(np.linalg.norm(v)), 6) for v in one] == [1, 1, 1, 0, 0, 0] and {len(v) for v in one} == {16}
    assert one[0] @ one[1] > 0.3 + one[0] @ one[2]


def test_vectors_are_learned_from_every_text(spark):
    # Each word but two is in two texts only: a text left out costs a word.
    texts = spark.range(240_000).select(F.concat(F.lit("word"), F.expr("id div 2"), F.lit(" side"), F.expr("id % 2")).alias("text"))
    model = TrainedVectors.fit(texts.union(texts), "text", dim=2)
    assert model.model.getVectors().count() == 120_002
    assert model.transform(texts, "text").where("embedding = array(0D, 0D)").count() == 0


def test_clusters_are_those_of_plain_rounds(spark):
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(c, 0.2, (40, 3)) for c in (-2, 0, 2)])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(999, None)], "id long, embedding array<double>")
    centres = clusters.kmeans_centres(df.repartition(5), "id", k=3)
    assert (centres == clusters.kmeans_centres(df.repartition(1), "id", k=3)).all()
    import hashlib

    whole = np.floor(points * clusters.STEPS + 0.5)
    start = sorted(range(len(points)), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())[:3]
    want = whole[start]
    for _ in range(clusters.ROUNDS):
        near = ((whole[:, None] - want[None]) ** 2).sum(axis=2).argmin(axis=1)
        want = np.array([np.floor_divide(whole[near == c].sum(axis=0), (near == c).sum()) if (near == c).any() else want[c] for c in range(3)])
    assert (centres == want).all()
    found = {r["id"]: r["c"] for r in df.select("id", clusters.nearest_centre(spark, centres).alias("c")).collect()}
    assert found[999] is None and [found[i] for i in range(120)] == ((whole[:, None] - want[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()


# ---- versions and totals ----


def test_as_of_with_ties_gaps_and_chunks(spark):
    rng = random.Random(8)
    day = lambda n: date(2023, 1, 1) + timedelta(n)
    versions = [(rng.choice("ab"), day(rng.randint(20, 400)), f"v{i}") for i in range(40)] + [("a", day(50), "v900"), ("a", day(50), "v901"), (None, day(1), "x"), ("b", None, "y")]
    rows = [(i, rng.choice(["a", "a", "b", "c", None]), None if i % 50 == 0 else day(rng.randint(0, 420))) for i in range(300)] + [(5, "a", day(50)), (5, "a", day(50))]

    def valid(key, at):
        known = [(t, v) for k, t, v in versions if k is not None and k == key and t is not None and at is not None and t <= at]
        return max(known, default=(None, None))

    want = sorted((i, str(k), str(t), *map(str, valid(k, t))) for i, k, t in rows)
    left = spark.createDataFrame(rows, "id int, key string, at date").repartition(4)
    right = spark.createDataFrame(versions, "key string, since date, version string")
    for seconds in (asof.CHUNK_SECONDS, 24 * 3600 * 3):
        out = asof.as_of_join(left, right, ["key"], "at", "since", seconds)
        assert out.columns == ["id", "key", "at", "since", "version"]
        assert sorted(tuple([r["id"], *map(str, (r["key"], r["at"], r["since"], r["version"]))]) for r in out.collect()) == want
    assert asof.as_of_join(left, right.limit(0), ["key"], "at", "since").where("version IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        asof.as_of_join(left, right.withColumnRenamed("version", "id"), ["key"], "at", "since")


def test_cube_has_all_totals(spark):
    rows = [("s1", "A", "A", "x", "x", "t", "u"), ("s1", "A", "B", "x", "x", "t", "t"), (None, None, "A", "x", "y", "t", "t")]
    df = spark.createDataFrame(rows, "supplier string, true_nominal string, pred_nominal string, true_department string, pred_department string, true_tc string, pred_tc string")
    out = {(r["field"], r["supplier"], r["level"]): (r["n"], r["n_correct"]) for r in metrics.metric_cube(df, ["supplier"]).collect()}
    assert out[(None, None, 3)] == (9, 5) and out[("nominal", None, 1)] == (3, 1) and out[("nominal", None, 0)] == (1, 0)
    assert out[(None, "s1", 2)] == (6, 4) and out[("tc", "s1", 0)] == (2, 1) and len(out) == 3 * 2 + 3 + 2 + 1
