"""Golden values worked out from the formulas, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import config
from lodestar.functions import text, vec
from lodestar.operators import axes, dedup, fusion, graph, propagation, residual, similarity
from lodestar.plans import inject, recall
from lodestar.sources import diaries, store
from lodestar.streaming import feed


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def edges(df):
    return {(r["src"], r["dst"]): r["weight"] for r in df.collect()}


# --- formulas


def test_phi_decay_gain(spark):
    one = lambda c: value(spark, c)
    assert [round(one(vec.phi(F.lit(p), F.lit(n))), 9) for p, n in ((1, 5), (2, 5), (3, 5), (5, 5), (1, 1))] == [0.9, 0.8, 0.7, 0.5, 0.9]
    assert [one(vec.distance_decay(F.lit(x))) for x in (1, 2, 3, 0)] == pytest.approx([1, math.exp(-0.08), math.exp(-0.16), 1])
    assert [one(vec.semantic_gain(F.lit(x))) for x in (0.05, 0.1, 0.65)] == pytest.approx([0.45, 0.5, 1.3])
    assert one(vec.semantic_gain(F.lit(float("nan")))) == 1.0
    assert one(vec.semantic_gain(F.lit(None).cast("double"))) == pytest.approx(0.5) and one(vec.semantic_gain(F.lit(-0.3))) == pytest.approx(0.5)
    assert vec.fir_weights() == pytest.approx([0.43373, 0.26024, 0.15614, 0.09369, 0.05621], abs=1e-5)


def test_vectors(spark):
    a = lambda *x: F.lit(list(map(float, x)))
    assert value(spark, vec.cosine_or_null(a(1, 0), a(0, 0))) is None and value(spark, vec.cosine_or_null(a(1, 0), a(1))) is None
    assert value(spark, vec.cosine_or_minus_one(a(1, 0), a(0, 0))) == -1.0 and value(spark, vec.cosine_unit_zero(a(1, 0), a(0, 0))) == 0.0
    assert value(spark, vec.normalize(a(0, 0))) == [0.0, 0.0]
    assert value(spark, vec.mix(a(1, 0), a(0, 1), 0.7, 0.3)) == pytest.approx([0.7 / math.sqrt(0.58), 0.3 / math.sqrt(0.58)])
    assert value(spark, vec.mix(a(2, 0), F.lit(None).cast("array<double>"), 0.7, 0.3)) == [1.0, 0.0]
    assert value(spark, vec.mix(a(1, 0), a(0, 0, 2), 0.7, 0.3)) == pytest.approx(np.array([0.7, 0, 0.6]) / math.hypot(0.7, 0.6))


def test_dynamic_chain(spark):
    boost = vec.effective_boost(F.lit(0.5), F.lit(0.5), F.lit(math.e - 1), F.lit(0.5))
    assert value(spark, boost) == pytest.approx(0.12) and value(spark, vec.core_boost(F.lit(0.5), F.lit(0.6))) == pytest.approx(1.29)
    assert value(spark, vec.effective_boost(F.lit(9.0), F.lit(0.0), F.lit(9.0), F.lit(1.0))) == pytest.approx(0.3)
    assert value(spark, vec.effective_boost(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))) == pytest.approx(0.045)


# --- graph


def fact(spark, files, vectors=(), cfg=config.Cooccurrence()):
    rows = [(f, t, i + 1) for f, tags in enumerate(files) for i, t in enumerate(tags)]
    occ = graph.occurrences(spark.createDataFrame(rows, "file long, tag_id long, pos int"))
    v = spark.createDataFrame([(i, list(map(float, x))) for i, x in vectors], "tag_id long, vector array<double>")
    return edges(graph.fact_matrix(occ, v, cfg))


def test_fact_matrix(spark):
    # Without vectors the gain is 0.5.
    assert fact(spark, [[0, 1]]) == pytest.approx({(0, 1): 0.225, (1, 0): 0.07875})
    three = fact(spark, [[0, 1, 2]])
    assert three[0, 1] == pytest.approx(0.315) and three[0, 2] == pytest.approx(0.45 * math.exp(-0.08) * 0.5)
    summed = fact(spark, [[0, 1], [0, 1], [1, 0]])
    assert summed == pytest.approx({(0, 1): 0.52875, (1, 0): 0.3825})
    guarded = fact(spark, [[0, 1]], cfg=config.Cooccurrence(reverse=2, reverse_max=2))
    assert guarded[1, 0] == pytest.approx(0.2025)
    repeated = fact(spark, [[0, 0, 1]])
    assert set(repeated) == {(0, 1), (1, 0)} and repeated[0, 1] == pytest.approx(0.5 * (0.9 * 0.5 * math.exp(-0.08) + 0.7 * 0.5))
    near = fact(spark, [[0, 1]], [(0, [3, 0]), (1, [2.6, 3.04])])
    s = 2.6 / math.hypot(2.6, 3.04)
    assert near[0, 1] == pytest.approx(0.45 * (0.5 + 0.8 * math.exp(-((s - 0.65) ** 2) / 0.125)))
    assert fact(spark, [[0]]) == {}


def test_kernel(spark):
    hub = [(0, 1, 2.0), (0, 2, 2.0), (1, 3, 1.0), (1, 4, 1.0), (2, 3, 1.0), (2, 5, 1.0), *((i, 1, 3.0) for i in range(3, 13))]
    df = spark.createDataFrame(hub, "src long, dst long, weight double")
    got = graph.kernel(df).collect()
    mass = {}
    for r in got:
        mass[r["src"]] = mass.get(r["src"], 0) + r["p"]
    assert all(m == pytest.approx(0.95) for m in mass.values())
    flow = graph.inflows(graph.conductance(df))
    assert flow.count() == 5
    values = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "x double")
    assert graph.upper_median(values, "x").first()["median"] == 3.0
    assert graph.upper_median(values.limit(0), "x").first()["median"] == 1.0
    assert graph.upper_median(values.filter("x < 4"), "x").first()["median"] == 2.0
    one = lambda w, r=None: graph.conductance(spark.createDataFrame([(0, 1, w)], "src long, dst long, weight double"), r).first()["is_wormhole"]
    high = spark.createDataFrame([(1, 2.5)], "tag_id long, residual double")
    assert one(2.0) and not one(0.5) and one(0.5, high)
    assert config.Kernel(outbound=5, reserve=9, hub_exponent=-1).clamped() == config.Kernel(1, 1, 1, 1.35, 1, 0, 0.55, 1.8, 0.1)


# --- propagation


def spread(spark, seeds, kernel, s=config.Spread()):
    seed = spark.createDataFrame([(0, n, float(w), c) for n, w, c in seeds], "query_id long, node long, weight double, is_core boolean")
    k = spark.createDataFrame([(a, b, float(p), bool(w)) for a, b, p, w in kernel], "src long, dst long, p double, is_wormhole boolean")
    return {r["node"]: r for r in propagation.propagate(seed, k, s).collect()}


W = vec.fir_weights()


def test_return_flow(spark):
    got = spread(spark, [(1, 5, False)], [(1, 2, 0.5, False), (2, 1, 0.5, False)])
    assert got[2]["energy"] == pytest.approx(0.625 * W[1])
    assert got[1]["energy"] == pytest.approx(5 * W[0] + 0.01171875 * W[2]) and got[1]["source_type"] == "seed"
    states = spark.createDataFrame([(0, 1, 2, 0.625, 1, "seed")], "query_id long, prev long, node long, energy double, momentum int, source_type string")
    top = spark.createDataFrame([(2, 1, 0.5, False)], "src long, dst long, p double, is_wormhole boolean")
    assert propagation.suppressed_mass(states, top).first()["suppressed"] == pytest.approx(0.06640625)


def test_momentum(spark):
    chain = [(i, i + 1, 1.8, False) for i in range(1, 5)]
    got = spread(spark, [(1, 1, False)], chain)
    assert got[2]["energy"] == pytest.approx(0.45 * W[1]) and got[3]["energy"] == pytest.approx(0.2025 * W[2]) and 4 not in got
    chain[1] = (2, 3, 1.8, True)
    got = spread(spark, [(1, 1, False)], chain)
    assert got[4]["energy"] == pytest.approx(0.25515 * W[3]) and 5 not in got
    assert (got[4]["hop"], got[4]["source_type"], got[4]["origin_type"]) == (3, "emergent", "seed")


def test_states_merge(spark):
    p = 1 / 0.7
    kernel = [(1, 3, 1 / 0.7, True), (2, 3, 0.9 / 0.7, True), (3, 4, 1.0, False), (4, 5, 1.0, False)]
    got = spread(spark, [(1, 1, True), (2, 1, False)], kernel)
    assert p and got[3]["energy"] == pytest.approx(1.9 * W[1]) and got[4]["energy"] == pytest.approx(0.475 * W[2]) and got[5]["energy"] == pytest.approx(0.11875 * W[3])
    assert got[3]["origin_type"] == "core"


def test_state_cap(spark):
    seeds = [(i, 1, False) for i in range(101)]
    kernel = [(i, 1000 + 20 * i + j, 1 / 0.7, True) for i in range(101) for j in range(25)]
    got = spread(spark, seeds, kernel)
    assert len(got) == 101 + 2000  # 2,020 states, of which 2,000 stay


def test_no_seeds(spark):
    assert spread(spark, [], [(1, 2, 0.5, False)]) == {} and set(spread(spark, [(7, 1, False)], [])) == {7}


# --- text


@pytest.mark.parametrize(
    ("raw", "want"),
    [("x\nTag: a, b", ["a", "b"]), ("Tag: a\nTag： b ，c、 d  e ,,a,a", ["b", "c", "d e", "a", "a"]), ("Tag:\nfoo", []), ("Tag: a\nTag:    ", []), ("Tag: a\nTag:", ["a"]), ("no", []), (None, []), ("  Tag : z\r\nmore", ["z"])],
)
def test_parse_tags(spark, raw, want):
    assert value(spark, text.parse_tags(F.lit(raw).cast("string"))) == want


def test_scalar_texts(spark):
    one = lambda c: value(spark, c)
    assert one(text.estimate_tokens(F.lit("ab中，"))) == math.ceil(0.5 + 3.0) and one(text.estimate_tokens(F.lit(None).cast("string"))) == 0
    assert one(text.sentences(F.lit("a. b!c\n\nd"))) == ["a.", " b!", "c\n", "\n", "d"]
    assert one(text.clean_tag(F.lit(" a，b、c "))) == "a, b, c" and one(text.sanitize_title(F.lit("..a/b:\t c..."))) == "ab c"
    assert one(text.normalize_text(F.lit("Ａ\r\n\n\n\nB \t c\u00a0"))) == "a\n\nb c" and one(text.normalize_path(F.lit(" A\\B "))) == "a/b"
    assert one(text.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2 and one(text.occurrences(F.lit("a"), F.lit(""))) == 0
    assert one(text.hash_embedding(F.lit("ab"), 4)) == [0.0, 97.0, 98.0, 0.0]
    assert one(text.is_technical(F.lit("node.js v-1"))) and not one(text.is_technical(F.lit("记忆"))) and not one(text.is_technical(F.lit("é")))
    assert one(text.notation(F.lit("t"), F.lit("3"), F.lit(0.744), F.lit("seed"), F.lit("0"))) == "=t:0.74@seed"
    assert one(text.notation(F.lit(None).cast("string"), F.lit("3"), F.lit(0.5), F.lit("emergent"), F.lit("2"))) == "~#3:0.50@emergent:2"


def test_chunks():
    words = "".join(f"Sentence number {i} is here. " for i in range(900))
    parts = text.chunks(words, 200, 40)
    assert all(text._weight(p) <= 200 for p in parts) and len(parts) > 20
    for a, b in zip(parts, parts[1:], strict=False):
        assert a.split(". ")[-1].rstrip(".") in b and text._weight(b) > 0
    assert {s.strip() for s in words.split(".") if s.strip()} == {s.strip() for p in parts for s in p.split(".") if s.strip()}
    assert "".join(text.forced_slices("x" * 5000, 200)) == "x" * 5000 and all(text._weight(p) <= 200 for p in text.chunks("x" * 5000, 200, 40))
    assert text.forced_slices("aaaa,bbbbbb", 2) == ["aaaa,", "bbbbbb"]
    assert text.chunks(None) == [] and text.chunks(" \n ") == [] and text.chunks("one") == ["one"]


# --- dedup


def test_hard_dedup(spark):
    rows = [(0, 0, ["text:a", "p:1"], 50, 0.5, 0), (0, 1, ["text:b", "p:2"], 50, 0.9, 0), (0, 2, ["text:a", "p:2"], 50, 0.7, 0), (1, 0, ["x"], 50, 0.1, 0), (1, 1, ["x", "y"], 50, 0.1, 0), (1, 2, ["y"], 50, 0.3, 0)]
    df = spark.createDataFrame(rows, "query_id long, ord long, names array<string>, priority int, score double, completeness int")
    got = sorted(tuple(r) for r in dedup.hard_dedup(df).collect())
    assert got == [(0, 1), (0, 2), (1, 2)]  # a row that knows two slots joins the first; names pass on within a slot


def test_semantic_dedup(spark):
    unit = lambda c: [c, math.sqrt(1 - c * c)]
    rows = [(0, 0, 0.9, 50, [1.0, 0.0]), (0, 1, 0.8, 50, unit(0.969)), (0, 2, 0.7, 50, unit(0.849)), (0, 3, 0.1, 50, None), (1, 0, 0.5, 50, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "query_id long, ord long, score double, priority int, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert sorted((r["query_id"], r["ord"]) for r in dedup.semantic_dedup(df, q, 0.92).collect()) == [(0, 0), (0, 2), (0, 3), (1, 0)]


def test_tag_dedup(spark):
    rows = [(0, 1, 1.0, False, [1.0, 0.0]), (0, 2, 0.5, True, [2.0, 0.2]), (0, 3, 0.4, False, [0.0, 1.0]), (0, 4, 9.0, False, None), (0, 5, 9.0, False, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "query_id long, tag_id long, weight double, is_core boolean, vector array<double>")
    assert sorted((r["tag_id"], r["weight"], r["is_core"]) for r in dedup.tag_dedup(df, 0.88).collect()) == [(1, pytest.approx(1.1), True), (3, 0.4, False)]


# --- axes and pyramid


def _tags(spark, n=20, dim=16):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(4, dim))
    v = [centres[i % 4] + 0.1 * rng.normal(size=dim) for i in range(n)]
    return spark.createDataFrame([(i, f"t{i}", (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)], "tag_id long, name string, vector array<double>")


def test_axes(spark):
    tags = _tags(spark)
    basis = axes.train(tags)
    assert np.allclose(basis.axes @ basis.axes.T, np.eye(len(basis.axes)), atol=1e-6) and (np.diff(basis.energies) <= 1e-9).all()
    again = axes.train(tags)
    assert np.allclose(basis.axes, again.axes)
    rows = axes.project(tags.select(F.col("tag_id").alias("query_id"), "vector"), basis).collect()
    for r in rows:
        assert sum(r["probabilities"]) == pytest.approx(1) and 0 <= r["entropy"] <= 1 + 1e-9 and r["depth"] == pytest.approx(1 - r["entropy"])
        assert [a["energy"] for a in r["dominant"]] == sorted((a["energy"] for a in r["dominant"]), reverse=True)
    assert axes.train(tags.limit(7)) is None
    flat = axes.project(spark.createDataFrame([(0, basis.mean.tolist())], "query_id long, vector array<double>"), basis).first()
    assert (flat["entropy"], flat["depth"], list(flat["dominant"])) == (1.0, 0.0, [])


def test_resonance(spark):
    c = F.array(*(F.struct(F.lit(i).alias("axis"), F.lit(e).alias("energy"), F.lit(0.0).alias("projection")) for i, e in enumerate((0.64, 0.25, 0.06))))
    assert value(spark, axes.resonance(c)) == pytest.approx(0.4 + math.sqrt(0.64 * 0.06))
    assert value(spark, axes.resonance(F.slice(c, 1, 1))) == 0.0


def test_pyramid(spark):
    dim = 32
    e = np.eye(dim)
    rng = np.random.default_rng(11)
    rest = rng.normal(size=(16, dim)) * (np.arange(dim) > 1)
    v = [e[0], e[1], *(x / np.linalg.norm(x) for x in rest)]
    tags = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "tag_id long, vector array<double>")
    q = spark.createDataFrame([(0, (0.8 * e[0] + 0.6 * e[1]).tolist()), (1, [0.0] * dim), (2, rng.normal(size=dim).tolist())], "query_id long, vector array<double>")
    levels = residual.pyramid(q, tags)
    got = {(r["query_id"], r["level"]): r for r in levels.collect()}
    first = got[0, 0]
    assert [t["tag_id"] for t in first["tags"]][:2] == [0, 1] and first["explained"] == pytest.approx(1) and first["tags"][0]["contribution"] == pytest.approx(0.8)
    assert (0, 1) not in got and not any(k == 1 for k, _ in got)
    ratios = [got[2, i]["ratio"] for i in range(3) if (2, i) in got]
    assert ratios == sorted(ratios, reverse=True)
    f = {r["query_id"]: r for r in residual.features(q, levels).collect()}
    assert tuple(f[1])[1:] == (0, 0.0, 1.0, 0.0, 0.0) and f[0]["coverage"] == pytest.approx(1)


# --- search and recall


def test_top_k(spark):
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)] + [(60, None), (61, [1.0])], "item_id long, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None)], "query_id long, vector array<double>")
    got = sorted((r["query_id"], r["rank"], r["item_id"]) for r in similarity.top_k(q, items, 3).collect())
    assert got == [(0, 1, 49), (0, 2, 48), (0, 3, 47), (1, 1, 0), (1, 2, 1), (1, 3, 2)]
    assert similarity.top_k(q, items, 3, floor=48.0).filter("query_id = 0").count() == 2
    assert similarity.top_k(q.limit(0), items, 3).count() == 0


def test_recall_adds_only(spark):
    tags = _tags(spark, 24)
    rng = np.random.default_rng(13)
    rows = tags.collect()
    chunks = [(i, f"f{i}", 0, f"text {i}", [float(x) for x in rng.normal(size=16)]) for i in range(40)]
    chunks = spark.createDataFrame(chunks, "chunk_id long, file string, chunk_index int, content string, vector array<double>").withColumn("vector", vec.normalize(F.col("vector")))
    occ = [(f"f{i}", int(rng.integers(0, 24)), p + 1) for i in range(40) for p in range(4)]
    occ = graph.occurrences(spark.createDataFrame(occ, "file string, tag_id long, pos int"))
    kernel = graph.kernel(graph.fact_matrix(occ, tags))
    index = recall.Index(chunks, tags, occ.select("file", "tag_id"), kernel, axes.train(tags))
    q = spark.createDataFrame([(i, rows[i]["vector"]) for i in range(3)] + [(3, [0.0] * 16)], "query_id long, vector array<double>")
    cores = spark.createDataFrame([(0, "T0")], "query_id long, name string")
    blocks, matched, stats = recall.recall(q, cores, index, config.merged({"recall": {"floor": 0.3}}))
    got = blocks.collect()
    for i in range(4):
        mine = [r for r in got if r["query_id"] == i]
        assert sum(not r["via_structure"] for r in mine) <= 6 and sum(r["via_structure"] for r in mine) <= 2
        assert all(r["score"] >= 0.3 for r in mine if not r["via_structure"]) and all(r["score"] < 0.3 for r in mine if r["via_structure"])
    assert {r["query_id"]: r["fused"] for r in stats.collect()} == {0: True, 1: True, 2: True, 3: False}
    assert {"t0": "core"}.items() <= {r["tag"]: r["source_type"] for r in matched.filter("query_id = 0").collect()}.items()
    off = recall.recall(q, cores, index, config.merged({"recall": {"enabled": False}}))
    assert {tuple(r) for r in off[0].collect()} == {tuple(r) for r in recall.plain(q, chunks).collect()}


def test_copies_hide_no_results(spark):
    """More near-equal chunks than the first pool holds, before eight that differ."""
    tags = _tags(spark, 24)
    rng = np.random.default_rng(17)
    q = np.array(tags.collect()[0]["vector"], float)
    q /= np.linalg.norm(q)
    unit = lambda v: [float(x) for x in v / np.linalg.norm(v)]
    rows = [unit(q + rng.normal(size=16) * 0.001) for _ in range(recall.POOL + 200)] + [unit(q * 0.8 + rng.normal(size=16) * 0.35) for _ in range(8)]
    chunks = spark.createDataFrame([(i, f"f{i}", 0, f"text {i}", v) for i, v in enumerate(rows)], "chunk_id long, file string, chunk_index int, content string, vector array<double>")
    occ = graph.occurrences(spark.createDataFrame([(f"f{i}", int(rng.integers(0, 24)), p + 1) for i in range(40) for p in range(4)], "file string, tag_id long, pos int"))
    index = recall.Index(chunks, tags, occ.select("file", "tag_id"), graph.kernel(graph.fact_matrix(occ, tags)), axes.train(tags))
    queries = spark.createDataFrame([(0, unit(q))], "query_id long, vector array<double>")
    cores = spark.createDataFrame([], "query_id long, name string")
    blocks = recall.recall(queries, cores, index, config.merged({"recall": {"floor": 0.1}}))[0].filter("not via_structure").collect()
    assert len(blocks) == 6 and sum(r["chunk_id"] < recall.POOL + 200 for r in blocks) == 1


def test_virtual_core(spark):
    tags = spark.createDataFrame([(1, "a", [1.0]), (2, "Core", [1.0])], "tag_id long, name string, vector array<double>")
    seed = spark.createDataFrame([(0, 1, 1.0, False, 0)], "query_id long, tag_id long, weight double, is_core boolean, level int")
    field = spark.createDataFrame([(0, 1, 0.4, 0, "seed", None)], "query_id long, node long, energy double, hop int, source_type string, origin_type string")
    boosts = spark.createDataFrame([(0, 1.29, 0.1), (1, 1.29, 0.1)], "query_id long, core_boost double, boost double")
    cores = spark.createDataFrame([(0, "cORE"), (1, "core")], "query_id long, name string")
    got = {(r["query_id"], r["tag_id"]): r["weight"] for r in fusion.field_tags(seed, field, boosts, tags, cores).collect()}
    assert got == {(0, 1): 1.0, (0, 2): pytest.approx(1.29 / 1.33), (1, 2): pytest.approx(1.29)}


# --- injection


def test_throttle_and_pack(spark):
    turns = [(0, i, r, t) for i, (r, t) in enumerate([("user", "A"), ("user", "A"), ("user", "B"), ("user", "A"), ("assistant", "x"), ("user", "A"), ("user", ""), ("user", " ")])]
    got = inject.throttled(inject.eligible(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).orderBy("turn").collect()
    assert [r["skip"] for r in got] == [False, True, False, False, False, False] and got[-1]["assistant_text"] == "x"
    blocks = spark.createDataFrame([(0, "f", 0.9, "a" * 50, 1), (0, "g", 0.8, "b" * 500, 2), (0, "h", 0.7, "c", 3), (1, "f", 0.9, "d" * 500, 1)], "query_id long, file string, score double, text string, ord long")
    out = {r["query_id"]: r for r in inject.packed(blocks, 200).collect()}
    assert out[0]["used"] == 1 and "b" * 9 not in out[0]["text"] and "[2]" not in out[0]["text"]
    assert out[1]["used"] == 1 and len(out[1]["text"]) == 200
    assert inject.packed(blocks, 5).first()["text"] == inject.HEAD + inject.FOOT


def test_throttle_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    spark.createDataFrame([(0, 1, "A"), (0, 2, "A"), (0, 3, "B"), (1, 1, "A"), (0, 4, "A")], "conv_id long, turn long, seed_key string").coalesce(1).write.mode("overwrite").json(str(src))
    stream = spark.readStream.schema("conv_id long, turn long, seed_key string").json(str(src))
    q = feed.throttle_stream(stream).writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["conv_id"], r["turn"], r["skip"]) for r in spark.table("throttled").collect()) == [(0, 1, False), (0, 2, True), (0, 3, False), (0, 4, False), (1, 1, False)]


# --- sources and store


def test_diaries(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.md").write_text("[2026-01-02] - ann\n[10:11]\nBody text.\n\nTag: x, y")
    (tmp_path / "a" / "b" / "two.md").write_text("free text")
    (tmp_path / "a" / "skip.txt").write_text("Tag: z")
    rows = diaries.read_diaries(spark, str(tmp_path))
    got = {r["file"].rsplit("/", 1)[1]: r for r in rows.collect()}
    assert set(got) == {"one.md", "two.md"}
    one = got["one.md"]
    assert (str(one["written_date"]), one["agent"], one["hhmm"], one["body"]) == ("2026-01-02", "ann", "10:11", "Body text.") and got["two.md"]["agent"] is None
    assert sorted((r["name"], r["pos"]) for r in diaries.tag_occurrences(rows).collect()) == [("x", 1), ("y", 2)]
    written = value(spark, diaries.diary_text(F.lit("2026-01-02"), F.lit("ann"), F.lit("10:11"), F.lit("B"), F.array(F.lit(" a，b、c "), F.lit("d"))))
    assert written.endswith("\n\nTag: a, b, c, d")
    none = diaries.embedded(rows, "raw", diaries.http_embedder("http://127.0.0.1:9", "m", 4, waits=(), timeout=1))
    assert all(r["vector"] is None for r in none.collect())


def test_read_chunks(spark, tmp_path):
    lines = ['{"id":1,"file":"a","chunkIndex":0,"content":"x","vector":[3,4]}', "broken", '{"id":2,"file":"a","chunkIndex":1,"content":"y","vector":[1]}', '{"id":3,"file":"gone","chunkIndex":0,"content":"z","vector":[0,2]}']
    (tmp_path / "chunks.jsonl").write_text("\n".join(lines))
    valid, counts = diaries.read_chunks(spark, str(tmp_path / "chunks.jsonl"), 2, spark.createDataFrame([("a",)], "file string"))
    assert [(r["id"], r["vector"]) for r in valid.collect()] == [(1, pytest.approx([0.6, 0.8]))] and tuple(counts.first()) == (2, 1)


def test_store(spark, tmp_path):
    home = f"file://{tmp_path}/store"
    assert store.current(spark, home) is None
    assert store.publish(spark, home, {"chunks": spark.range(3)}, "m@4") == 1
    assert store.publish(spark, home, {"chunks": spark.range(5)}, "m@4") == 2
    assert store.load(spark, home, "chunks", "m@4").count() == 5
    with pytest.raises(store.SignatureMismatch):
        store.publish(spark, home, {"chunks": spark.range(1)}, "m@8")
    with pytest.raises(store.SignatureMismatch):
        store.load(spark, home, "chunks", "m@8")
    assert store.publish(spark, home, {"chunks": spark.range(1)}, "m@8", rebuild=True) == 3
    files = spark.createDataFrame([("a", "one target text here", 1), ("b", "one target text here, one target text here", 2), ("c", "other", 3)], "file string, raw string, mtime long")
    asks = spark.createDataFrame([(1, "one target text", "N"), (2, "short", "N"), (3, "nowhere to be found", "N"), (4, "one target text here,", "N")], "request_id long, target string, replacement string")
    got = {r["request_id"]: (r["file"], r["updated"], r["error"]) for r in store.updates(files, asks).collect()}
    assert got == {1: (None, None, "ambiguous"), 2: (None, None, "too short"), 3: (None, None, "not found"), 4: ("b", "N one target text here", None)}


def test_config():
    assert config.clamp_int("7.6", 1, 20, 6) == 8 and config.clamp_int("x", 1, 20, 6) == 6 and config.clamp_int(99, 1, 20, 6) == 20
    assert config.clamp_float(None, 0, 1, 0.4) == 0.4 and config.clamp_float(float("nan"), 0, 1, 0.4) == 0.4
    with pytest.raises(ValueError):
        config.merged({"nope": {}})


def brute_hard_dedup(rows):
    """Slots of rows (ord, names, rank) in order; names move to the slot that a row joins."""
    slots, owner = [], {}
    for at, names, rank in sorted(rows):
        hit = next((owner[n] for n in names if n in owner), None)
        if hit is None:
            slots.append((rank, at, names))
            hit = len(slots) - 1
        moved = [*slots[hit][2], *names]
        if rank > slots[hit][0]:
            slots[hit] = (rank, at, names)
        owner |= dict.fromkeys(moved, hit)
    return sorted(at for _, at, _ in slots)


def test_hard_dedup_moves_names(spark):
    import random

    from lodestar.registry import QUERIES

    random.seed(4)
    rows = [(q, i, random.sample("abcdefgh", random.randrange(0, 4)), random.randrange(3), float(random.randrange(4)), random.randrange(3)) for q in range(60) for i in range(14)]
    rows += [(99, i, list(n), 0, s, 0) for i, (n, s) in enumerate([("ap", 0.5), ("bq", 0.9), ("aq", 0.7), ("cq", 0.1), ("dq", 0.95)])]
    df = spark.createDataFrame(rows, "query_id long, ord long, names array<string>, priority int, score double, completeness int")
    got = sorted((r["query_id"], r["ord"]) for r in dedup.hard_dedup(df).collect())
    want = [(q, o) for q in sorted({r[0] for r in rows}) for o in brute_hard_dedup([(i, n, (p, s, c)) for k, i, n, p, s, c in rows if k == q])]
    assert got == want and [o for q, o in got if q == 99] == [1, 4]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    norm = {r["doc_id"]: r["n"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", text.normalize_text(F.col("text")).alias("n")).collect()}
    by_query = {}
    for r in docs:
        k = r["doc_id"]
        names = ([f"chunk:{k % 17}"] if k % 3 else []) + [f"text:{norm[k]}", f"path-chunk:{r['source'].lower()}:{k % 5}"]
        by_query.setdefault(k // 50, []).append((k, names, (k % 2 * 10, float(k * 7 % 11), len(r["text"]))))
    assert sorted((r["query_id"], r["ord"]) for r in QUERIES["hard_dedup_general"](spark, "/root/testdata/sf0.001").collect()) == [(q, o) for q in sorted(by_query) for o in brute_hard_dedup(by_query[q])]


def test_top_k_in_many_batches_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    items = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(700)]  # many ties
    df = spark.createDataFrame(items, "item_id long, vector array<double>").repartition(3)
    queries = df.filter("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    matrix = np.array([v for _, v in items])
    want = {(q, int(i), r + 1) for q in range(0, 700, 20) for r, i in enumerate(sorted(range(700), key=lambda i: (-float(matrix[q] @ matrix[i]), i))[:5])}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        for block in (4096, 4):
            monkeypatch.setattr(similarity, "QUERY_BLOCK", block)
            monkeypatch.setattr(similarity, "PASS_BLOCKS", 3)
            assert {(r["query_id"], r["item_id"], r["rank"]) for r in similarity.top_k(queries, df, 5).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_eligible_sources(spark):
    rows = [(1, 0, "user", "a", "user"), (1, 1, "user", "remembered", "plugin"), (1, 2, "user", "\t\n", "user"), (1, 3, "user", "", "user"), (1, 4, "user", None, "user")]
    got = inject.eligible(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, source_kind string")).collect()
    assert sorted(r["turn"] for r in got) == [0, 2]


def test_bounded_recall(spark):
    import time

    assert inject.within(spark, 60, lambda: spark.range(5).count()) == 5
    began = time.time()
    slow = F.udf(lambda x: time.sleep(20) or x, "long")
    assert inject.within(spark, 1, lambda: spark.range(1).select(slow("id").alias("x")).collect()) is None
    assert time.time() - began < 10
    with pytest.raises(ValueError):
        inject.within(spark, 60, lambda: int("x"))


def test_arguments_are_clamped(spark):
    items = spark.createDataFrame([(i, f"f{i}", 0, f"text {i}", [1.0, i / 100]) for i in range(40)], "chunk_id long, file string, chunk_index int, content string, vector array<double>").withColumn("vector", vec.normalize(F.col("vector")))
    tags = spark.createDataFrame([(0, "one", [1.0, 0.0])], "tag_id long, name string, vector array<double>")
    index = recall.Index(items, tags, spark.createDataFrame([], "file string, tag_id long"), spark.createDataFrame([], "src long, dst long, p double, is_wormhole boolean"), None)
    q, cores = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>"), spark.createDataFrame([], "query_id long, name string")
    for k, floor, n in ((99, 0, 20), ("2.6", 7, 1), (0, -1, 1), ("x", None, 6), (None, float("nan"), 6)):
        blocks, matched, stats = recall.ask(q, cores, index, k, floor)
        assert blocks.count() == n, (k, floor)
    assert [tuple(r) for r in matched.select("rank", "tag", "level", "source_type", "notation").collect()] == [(1, "one", 0, "seed", "=one:1.00@seed")]  # an index without axes names tags by the pyramid
    assert not stats.first()["fused"]
    assert config.Injection(k=99, floor=-1, max_chars="x").clamped() == config.Injection(k=20, floor=0.0)


def test_suppression_in_rounds(spark, monkeypatch):
    """Small first pools, crowds around a query, equal texts of other vectors, a bound on scores and tags, against one pass."""
    monkeypatch.setattr(recall, "LEAST_POOL", 3)
    monkeypatch.setattr(recall, "SHARE", 1)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 12))
    rows = []
    for i in range(600):
        v = centres[i % 3 if i < 400 else i % 9] + (0.05 if i < 400 else 0.9) * rng.normal(size=12)
        rows.append((i, f"T{i // 7}" if i % 5 == 0 else f"u{i}", (v / np.linalg.norm(v)).tolist(), [i % 4, i % 6] if i % 11 else None))
    detail = spark.createDataFrame(rows, "item_id long, text string, vector array<double>, tags array<long>")
    asked = [(q, (centres[q % 9] / np.linalg.norm(centres[q % 9])).tolist()) for q in range(9)]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")

    def plain(q, need, floor, below, nodes):
        order = sorted(((-float(np.dot(q, v)), i, t, np.array(v)) for i, t, v, tags in rows if (nodes is None or set(tags or ()) & nodes)), key=lambda x: x[:2])
        texts, kept = set(), []
        for s, i, t, v in order:
            if (floor is not None and -s < floor) or (below is not None and -s >= below) or t.lower() in texts:
                continue
            texts.add(t.lower())
            if all(v @ k < 0.7 for _, k in kept):
                kept.append((i, v))
        return [i for i, _ in kept[:need]]

    nodes = spark.createDataFrame([(q, [q % 4, 5]) for q in range(8)], "query_id long, nodes array<long>")
    for floor, below, some in ((None, None, None), (0.1, None, None), (None, 0.8, nodes)):
        got = {}
        for r in recall.survivors(queries, detail if some is not None else detail.drop("tags"), 12, floor, 0.7, below=below, nodes=some).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["ord"])
        for q, v in asked:
            want = [] if some is not None and q == 8 else plain(v, 12, floor, below, None if some is None else {q % 4, 5})
            assert got.get(q, []) == want, (floor, below, q)


def test_search_holds_small_pools(spark, monkeypatch):
    """A crowd of near copies is left out once one of them is kept, so no pool grows with it."""
    pools, ranked = [], recall.ranked
    monkeypatch.setattr(recall, "ranked", lambda q, i, k, *a: pools.append(k) or ranked(q, i, k, *a))
    rng = np.random.default_rng(5)
    near = np.eye(16)[0] + 0.01 * rng.normal(size=(3000, 16))
    far = np.eye(16)[0] * 0.8 + 0.35 * rng.normal(size=(8, 16))
    rows = [(i, f"u{i}", (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(np.concatenate([near, far]))]
    detail = spark.createDataFrame(rows, "item_id long, text string, vector array<double>")
    queries = spark.createDataFrame([(0, np.eye(16)[0].tolist())], "query_id long, vector array<double>")
    got = [r["ord"] for r in recall.survivors(queries, detail, 6, None, 0.92).collect()]
    assert len(got) == 6 and sum(i < 3000 for i in got) == 1 and max(pools) <= 100


def test_pack_hands_on_what_can_fit(spark):
    """Long texts and many rows of a query: the same blocks, and each task hands on a bounded number of short rows."""
    rows = [(0, "f", i, chr(97 + i % 26) * (5 + i * 7 % 4000), (i % 50) / 50.0) for i in range(4000)] + [(1, "", 0, "x" * 5000, float("nan"))] + [(2, "", i, "", float("nan")) for i in range(300)]
    df = spark.createDataFrame(rows, "query_id long, file string, ord long, text string, score double").repartition(3)
    packed = inject.packed(df)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.rindex("WindowGroupLimit") > plan.rindex("Exchange hashpartitioning(query_id")
    room = 2000 - len(inject.HEAD) - len(inject.FOOT)
    for r in packed.collect():
        mine = sorted((x for x in rows if x[0] == r["query_id"]), key=lambda x: (-x[4] if x[4] == x[4] else -9.0, x[2]))
        body, used = "", 0
        for n, (_, file, _, text, score) in enumerate(mine, 1):
            head = f"\n[{n}] (score {'NaN' if score != score else format(score, '.2f')} · {file})\n"
            if len(body) + len(head) + len(text) + 1 > room:
                if n == 1:
                    body, used = head + text[: room - len(head) - 1] + "\n", 1
                break
            body, used = body + head + text + "\n", used + 1
        assert (r["used"], r["text"]) == (used, inject.HEAD + body + inject.FOOT), r["query_id"]
