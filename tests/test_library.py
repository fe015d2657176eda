"""The curation library against plain Python and on edge cases."""

import json
import math
import random
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quern.functions import keys, text
from quern.operators import activity, composition, dedup, graph, metrics, near_groups, policy, replay, similarity, split, weights
from quern.plans import checks
from quern.plans.checks import CheckFailed
from quern.sources import archives, files, markers
from quern.streaming import histories


def record(i, **other):
    base = {"record_id": f"r{i}", "dataset": "A", "source_version": "1", "role": "training_candidate", "mapping_status": "MATCHED", "target_class": "x", "source_label": "x", "source_path": f"p{i}", "sha256": f"s{i}"}
    return Row(**base | other)


def test_keys(spark):
    import hashlib

    row = spark.range(1).select(keys.record_id(F.lit("d"), F.lit("1"), F.lit("r"), F.lit("p")).alias("a"), keys.split_group_id(F.lit("d"), F.lit("m"), F.lit(""), F.lit(None)).alias("b"), keys.split_group_id(F.lit("d"), F.lit("m"), F.lit("e"), F.lit("f")).alias("c")).first()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert row.a == "rec_" + digest("d\0001\0r\0p")[:20]
    assert row.b == "split_single_" + digest("d\0singleton\0m")[:24]
    assert row.c == "split_group_" + digest("d\0refined\0f")[:24]
    seq = [random.Random(1).randint(1, 9) for _ in range(70)]
    got = spark.createDataFrame([(seq,), ([1, 2],)], "s array<int>").select(keys.step_hash(F.col("s")).alias("h")).collect()
    want = sum(1 << i for i in range(64) if seq[i + 1] > seq[i])
    assert got[0].h % (1 << 64) == want and got[1].h is None


def test_text(spark):
    name = lambda s: spark.range(1).select(text.portable_name(F.lit(s))).first()[0]
    assert [name(s) for s in ("a:b/c", " .x. ", "con", "...", "ok")] == ["a_b_c", "x", "_con", "unnamed", "ok"]
    row = spark.range(1).select(text.unsafe_path(F.lit("a/../b")), text.unsafe_path(F.lit("C:x")), text.unsafe_path(F.lit("a/b..c")), text.is_benchmark_path(F.lit("PlantSet"), F.lit("Test\\a.jpg"), "plantset"), text.is_benchmark_path(F.lit("other"), F.lit("test/a"), "plantset")).first()
    assert tuple(row) == (True, True, False, True, False)
    status = lambda i, l, c: spark.range(1).select(text.scan_status(F.lit(i), F.lit(l), F.lit(c))).first()[0]
    assert [status(4, "x", 99.0), status(1, "Tomato healthy", 59.9), status(1, "Tomato Healthy", 60.0), status(1, "Blight", 60.0)] == ["no_leaf", "uncertain", "healthy", "diseased"]
    assert spark.range(1).select(text.is_false(F.lit(None).cast("boolean")), text.is_false(F.lit(False))).first()[:] == (False, True)


def test_exact_policy(spark):
    rows = [
        record(1, sha256="a"), record(2, sha256="a", role="locked_test"),
        record(3, sha256="b"), record(4, sha256="b", target_class="y"),
        record(6, sha256="c", source_path="2"), record(5, sha256="c", source_path="1"), record(7, sha256="c", mapping_status="AMBIGUOUS", target_class=""),
        record(8),
    ]
    got = {r.record_id: (r.cleaning_status, r.exclusion_reason, r.canonical_record_id) for r in dedup.apply_exact_policy(policy.initial_cleaning(spark.createDataFrame(rows))).collect()}
    assert got["r1"] == ("EXCLUDE", "EXACT_BENCHMARK_LEAKAGE", None) and got["r2"][1] == "LOCKED_BENCHMARK"
    assert got["r3"][1] == got["r4"][1] == "EXACT_LABEL_CONFLICT"
    assert got["r5"] == ("INCLUDE", "", "r5") and got["r6"] == ("EXCLUDE", "EXACT_DUPLICATE_COPY", "r5")
    assert got["r7"][1] == "AMBIGUOUS_MAPPING" and got["r8"][0] == "INCLUDE"


@pytest.mark.parametrize("bound", [0, 2, 4])
def test_hamming_join(spark, bound):
    rng = random.Random(bound)
    base = [rng.getrandbits(64) for _ in range(15)]
    values = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + [base[0], base[0] ^ 15, base[0] ^ 255]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame([(f"r{i:03}", h, f"s{i % 31}") for i, h in enumerate(signed)] + [("none", None, "s")], "record_id string, hash long, sha256 string")
    got = {(r.first, r.second): r.distance for r in similarity.hamming_self_join(rows, bound).collect()}
    want = {}
    for i, a in enumerate(values):
        for j in range(i + 1, len(values)):
            d = (a ^ values[j]).bit_count()
            if d <= bound and i % 31 != j % 31:
                want[f"r{i:03}", f"r{j:03}"] = d
    assert got == want and similarity.hamming_self_join(rows, bound).count() == len(want)
    cross = {(r.left_id, r.right_id) for r in similarity.hamming_join(rows.limit(20), rows, bound).collect()}
    assert all((k, k) in cross for k in [f"r{i:03}" for i in range(20)])


def serial_anchor(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    groups = {}
    for v in sorted(near):
        reps = [r for r in groups if r in near[v]]
        groups.setdefault(min(reps) if reps else v, []).append(v)
    return {v: r for r, vs in groups.items() if len(vs) > 1 for v in vs}


def test_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(i, i + 1) for i in range(100, 112)]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.v: r.representative for r in graph.anchor_groups(df).collect()} == serial_anchor(edges)
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.v: r.component for r in graph.components(df).collect()} == root
    assert graph.components(df.limit(0)).count() == graph.anchor_groups(df.limit(0)).count() == 0


def test_anchors_of_long_chains(spark):
    """A path whose every vertex waits for the one before, beside random graphs; folded whole, and in rounds alone."""
    rng = random.Random(4)
    path = [(i, i + 1) for i in range(5000)]
    wild = [(10_000 + rng.randrange(300), 10_000 + rng.randrange(300)) for _ in range(400)]
    edges = [e for e in path + wild if e[0] != e[1]]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.v: r.representative for r in graph.anchor_groups(df, rounds=1).collect()} == serial_anchor_fast(edges)
    few = [(f"n{a:02}", f"n{b:02}") for a, b in path[:30]]
    got = graph.anchor_groups(spark.createDataFrame(few, "a string, b string"), rounds=2, fold_edges=0)
    assert {r.v: r.representative for r in got.collect()} == serial_anchor(few)


def serial_anchor_fast(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    reps, out = set(), {}
    for v in sorted(near):
        own = near[v] & reps
        out[v] = min(own) if own else v
        if not own:
            reps.add(v)
    held = {r for v, r in out.items() if v != r}
    return {v: r for v, r in out.items() if r in held}


def test_stored_rates(spark):
    losses = [1.0, 0.9, 0.95, 0.96, 0.97, 0.98, 0.5]
    due = [1e-3]
    for n in range(1, len(losses)):
        due.append(serial_plateau(losses[:n], 1e-3, 0.5, 2, 1, 1e-6)[3])
    first = next(i for i, r in enumerate(due) if r != 1e-3)
    rows = [("kept", i, x, r) for i, (x, r) in enumerate(zip(losses, due), 1)] + [("flat", i, x, 1e-3) for i, x in enumerate(losses, 1)]
    got = replay.rate_faults(spark.createDataFrame(rows, "k string, e int, x double, r double"), "k", "e", "x", "r").collect()
    assert [(r.k, r.step, r.stored, r.due) for r in got] == [("flat", first + 1, 1e-3, due[first])]


def test_composition(spark):
    taxonomy = spark.createDataFrame([("x", 0), ("y", 1)], "target_class string, target_index int")
    rows = spark.createDataFrame([record(i, target_class="xy"[i % 2], exact_group_id="g" if i < 2 else "", refined_group_id="") for i in range(4)])
    sides = [composition.combined_records(rows.where(c), d, taxonomy, {"is matched": F.col("mapping_status") == "MATCHED"}, "P") for c, d in (("record_id < 'r2'", composition.HISTORICAL), ("record_id >= 'r2'", composition.REAL_WORLD))]
    out = composition.compose(*sides, taxonomy).collect()
    assert [r.composition_record_id for r in out] == sorted(r.composition_record_id for r in out) and {r.source_record_id for r in out} == {f"r{i}" for i in range(4)}
    assert len({r.split_group_id for r in out}) == 3
    with pytest.raises(CheckFailed, match="collisions"):
        composition.compose(sides[0], sides[1].withColumn("sha256", F.lit("s0")), taxonomy)
    with pytest.raises(CheckFailed, match="missing_classes"):
        composition.compose(sides[0].where("target_class = 'x'"), sides[1].where("target_class = 'x'"), taxonomy)
    with pytest.raises(CheckFailed, match="is matched"):
        composition.combined_records(rows.withColumn("mapping_status", F.lit("AMBIGUOUS")), "D", taxonomy, {"is matched": F.col("mapping_status") == "MATCHED"}, "P")
    with pytest.raises(CheckFailed, match="target_class"):
        composition.combined_records(rows.withColumn("target_class", F.lit("z")), "D", taxonomy, {}, "P")


def test_audit_look_ups_and_overrides(spark):
    entries = spark.createDataFrame([("p", "a", bytearray(b"one"), keys_sha(b"one")), ("q", "b", bytearray(b""), keys_sha(b""))], "source_path string, source_label string, content binary, stored_sha256 string")
    mapping = spark.createDataFrame([("a", "MATCHED", "x"), ("b", "AMBIGUOUS", None)], "source_label string, mapping_status string, target_class string")
    got = {r.source_path: (r.bytes, r.target_class, r.candidate_status) for r in composition.audited(entries, mapping).collect()}
    assert got == {"p": (3, "x", "APPROVED_CANDIDATE"), "q": (0, "", "AMBIGUOUS")}
    with pytest.raises(CheckFailed, match="as stored"):
        composition.audited(entries.withColumn("content", F.lit(b"other")), mapping).collect()
    with pytest.raises(CheckFailed, match="source_label"):
        composition.audited(entries, mapping.limit(1)).collect()
    scans = spark.createDataFrame([(1, "Background without leaves", 0), (2, "Apple scab", 0), (3, "Apple healthy", 5), (4, "Bell pepper spot", 6), (5, "Rust", None), (6, None, 9)], "id int, label string, class_index int")
    meta = spark.createDataFrame([(0, "Scab")], "class_index int, disease_name string")
    assert {r.id: (r.plant, r.disease, r.kind) for r in composition.guidance(scans, meta).collect()} == {1: ("Unknown", "No leaf detected", "none"), 2: ("Apple", "Scab", "reference"), 3: ("Apple", "Healthy plant", "healthy"), 4: ("Bell", "pepper spot", "general"), 5: ("Rust", "Rust", "general"), 6: ("Plant", "", "general")}
    a, b = spark.createDataFrame([("k", 1), ("l", 2)], "key string, v int"), spark.createDataFrame([("l", 3), ("m", 4)], "key string, v int")
    assert {tuple(r) for r in composition.overrides(a, b, "key").collect()} == {("k", 1), ("l", 3), ("m", 4)}
    side = lambda rows: spark.createDataFrame(rows, "section string, value string")
    assert {tuple(r) for r in composition.changed_sections(side([("a", "1"), ("b", "2"), ("c", None)]), side([("a", "1"), ("b", "3"), ("c", None), ("d", "4")])).collect()} == {("b", "changed"), ("d", "removed")}


def keys_sha(data):
    import hashlib

    return hashlib.sha256(data).hexdigest()


def test_perceptual_hits(spark):
    rows = [("h1", "t1", True, False, "x", "x", "VERIFIED_NEAR_DUPLICATE", "HISTORICAL_TO_PLANTDOC_TEST"), ("h1", "h2", True, True, "x", "y", "POSSIBLE_NEAR_DUPLICATE", "INTERNAL_HISTORICAL"), ("h3", "h4", True, True, "x", "x", "VERIFIED_NEAR_DUPLICATE", "INTERNAL_HISTORICAL"), ("t2", "h5", False, True, "x", "y", "POSSIBLE_NEAR_DUPLICATE", "HISTORICAL_TO_PLANTDOC_TEST"), ("h6", "v", True, False, "x", "x", "VERIFIED_NEAR_DUPLICATE", "HISTORICAL_TO_DATASET_V2")]
    signals = spark.createDataFrame(rows, "first string, second string, a_historical boolean, b_historical boolean, a_target string, b_target string, status string, risk string")
    got = {r.record_id: (r.status, r.reason) for r in composition.perceptual_policy(signals).collect()}
    assert got == {"h1": ("EXCLUDE_BENCHMARK_LEAKAGE", "HISTORICAL_BENCHMARK_LEAKAGE_PERCEPTUAL"), "h2": ("REVIEW_PERCEPTUAL_CONFLICT", "POSSIBLE_CROSS_CLASS_PERCEPTUAL_CONFLICT"), "h5": ("REVIEW_PERCEPTUAL_CONFLICT", "POSSIBLE_HISTORICAL_BENCHMARK_LEAKAGE")}


def test_markers(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "i long, t string")
    built = []
    build = lambda: built.append(1) or rows
    for _ in range(2):
        assert markers.materialised(spark, str(tmp_path), "one", build).count() == 20
    assert len(built) == 1
    assert markers.materialised(spark, str(tmp_path), "two", build).count() == 20 and len(built) == 2
    rows.where("i > 0").write.mode("append").parquet(f"{tmp_path}/rows")
    with pytest.raises(CheckFailed):
        markers.check_marker(spark.read.parquet(f"{tmp_path}/rows"), f"{tmp_path}/marker", "two")
    assert markers.content_digest(rows) == markers.content_digest(rows.repartition(3).select("t", "i"))
    assert markers.content_digest(rows.limit(0))[0] == 0


def test_decisions(spark):
    hits = spark.createDataFrame([("r", 1, 0, "REVIEW", "a"), ("r", 3, 1, "EXCLUDE", "b"), ("r", 3, 2, "EXCLUDE", "c")], "record_id string, severity int, seq int, status string, reason string")
    assert policy.strongest(hits).first().reason == "c"
    cases = [("INCLUDE", "REVIEW"), ("EXCLUDE", "REVIEW"), ("EXCLUDE", "INCLUDE"), ("REVIEW", "EXCLUDE"), ("REVIEW", "INCLUDE"), ("INCLUDE", None)]
    rows = spark.createDataFrame([(i, s, "old", w, "new") for i, (s, w) in enumerate(cases)], "i int, s string, r string, w string, n string")
    status, reason = policy.apply_decision(F.col("s"), F.col("r"), F.col("w"), F.col("n"))
    assert [tuple(r) for r in rows.orderBy("i").select(status, reason).collect()] == [("REVIEW", "new"), ("EXCLUDE", "old"), ("EXCLUDE", "old"), ("EXCLUDE", "new"), ("INCLUDE", ""), ("INCLUDE", "old")]


def test_uncertain_records_end_excluded(spark):
    rows = spark.createDataFrame([("a", "REVIEW", "STILL_UNCERTAIN"), ("b", "REVIEW", "other"), ("c", "INCLUDE", "")], "record_id string, cleaning_status string, exclusion_reason string")
    got = {r.record_id: (r.cleaning_status, r.exclusion_reason) for r in policy.finalise(rows).collect()}
    assert got == {"a": ("EXCLUDE", "UNRESOLVED_PERCEPTUAL_IDENTITY"), "b": ("REVIEW", "other"), "c": ("INCLUDE", "")}


def near_rows(spark, seed):
    """Records of few hashes and texts, with copies, and all their near pairs by brute force."""
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(5)]
    hashes = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(3)]
    texts = [(f"s{i:02}", hashes[i % len(hashes)]) for i in range(45)]
    order = rng.sample(range(1000), 90)
    rows = []
    for i in order:
        sha, h = rng.choice(texts)
        rows.append((f"r{i:03}", h - (1 << 64) if h >> 63 else h, sha, rng.choice(["training_candidate"] * 3 + ["locked_test"]), rng.choice(["x", "y", ""]), rng.choice("de")))
    df = spark.createDataFrame(rows, "record_id string, hash long, sha256 string, role string, target_class string, dataset string")
    pairs = [(*sorted((a, b)), ((a[1] ^ b[1]) & (1 << 64) - 1).bit_count()) for i, a in enumerate(rows) for b in rows[:i] if a[2] != b[2]]
    return df, [p for p in pairs if p[2] <= 4]


def category_of(a, b):
    if a[3] != b[3]:
        return "TRAIN_TO_LOCKED_BENCHMARK"
    if a[3] == "training_candidate" and a[4] and b[4] and a[4] != b[4]:
        return "DIFFERENT_TARGET"
    if a[4] and a[4] == b[4]:
        return "SAME_TARGET_SAME_SOURCE" if a[5] == b[5] else "SAME_TARGET_CROSS_SOURCE"
    return "OTHER"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_groups_equal_what_all_pairs_give(spark, seed):
    df, pairs = near_rows(spark, seed)
    rows, links = near_groups.near_records(df, 4)
    root = {v[0]: v[0] for p in pairs for v in p[:2]}
    for _ in range(20):
        for a, b, _d in pairs:
            root[a[0]] = root[b[0]] = min(root[a[0]], root[b[0]])
    assert {r.v: r.component for r in near_groups.components(rows, links).collect()} == root
    want = {}
    for a, b, d in pairs:
        n, least = want.get(k := (root[a[0]], category_of(a, b), d), (0, ("~", "~")))
        want[k] = (n + 1, min(least, (a[0], b[0])))
    cells = near_groups.pair_cells(rows, links)
    assert {(r.component, r.category, r.distance): (r.n, (r.first, r.second)) for r in cells.collect()} == want
    own = serial_anchor([(a[0], b[0]) for a, b, _ in pairs])
    hashes = near_groups.anchored(rows, links)
    assert {r.v: r.representative for r in near_groups.members(rows, hashes).collect()} == own
    ends, heads = {}, {}
    for a, b, d in pairs:
        x, y = own.get(a[0], a[0]), own.get(b[0], b[0])
        if x != y:
            ends.setdefault((min(x, y), max(x, y)), []).append(d)
        for v, w in ((a[0], b[0]), (b[0], a[0])):
            if own.get(v) == w:
                heads.setdefault(w, []).append(d)
    assert {(r.entity_a, r.entity_b): (r.n_pairs, r.min_distance) for r in near_groups.contracted(rows, links, hashes).collect()} == {k: (len(d), min(d)) for k, d in ends.items()}
    assert {r.representative: (r.edges, r.nearest, r.farthest) for r in near_groups.edge_summary(rows, hashes).collect()} == {k: (len(d), min(d), max(d)) for k, d in heads.items()}
    assert {r.record_id for r in near_groups.in_conflict(rows, links).collect()} == {a[0] for a, b, _ in pairs if category_of(a, b) == "DIFFERENT_TARGET"}


def test_copies_of_one_hash_make_no_pairs(spark, tmp_path):
    """4,000 texts of one hash are 8 million pairs of records, and a count."""
    rows = spark.range(4000).selectExpr("printf('r%05d', id) as record_id", "7L as hash", "cast(id as string) as sha256", "'training_candidate' as role", "'x' as target_class", "'d' as dataset")
    kept, links = near_groups.near_records(rows, 4)
    cells = near_groups.pair_cells(kept, links)
    assert [tuple(r) for r in cells.collect()] == [("r00000", "SAME_TARGET_SAME_SOURCE", 0, 4000 * 3999 // 2, "r00000", "r00001")]
    hashes = near_groups.anchored(kept, links)
    assert near_groups.members(kept, hashes).count() == 4000 and near_groups.contracted(kept, links, hashes).count() == 0


def test_split_targets_and_allocation(spark):
    got = spark.range(1, 60).select("id", split.integer_targets(F.col("id")).alias("w")).collect()
    for r in got:
        raw = {s: r.id * split.RATIOS[s] for s in split.SPLITS}
        assert (r.w.TRAIN, r.w.VALIDATION, r.w.TEST) == tuple(split._whole(r.id)[s] for s in split.SPLITS)
        assert sum(r.w) == r.id and all(abs(r.w[s] - raw[s]) < 1 for s in split.SPLITS)
    hundred = [(f"g{i}", 1) for i in range(100)]
    assert Counter(split.allocate(hundred).values()) == {"TRAIN": 80, "VALIDATION": 10, "TEST": 10}
    assert split.allocate(hundred[::-1]) == split.allocate(hundred)
    assert Counter(split.allocate(hundred[:30]).values()) == {"TRAIN": 24, "VALIDATION": 3, "TEST": 3}
    assert set(split.allocate(hundred[:2]).values()) == {"TRAIN"}
    rows = spark.createDataFrame([(f"g{i}", "c", d, "s", f"{d}{i}") for d in ("A", "B") for i in range(100)], "split_group_id string, target_class string, source_domain string, source_dataset string, sha256 string")
    rows = rows.withColumn("split_group_id", F.concat("source_domain", "split_group_id"))
    done = split.with_split(rows, split.assign_splits(split.split_groups(rows)))
    assert {(r.source_domain, r.split): r["count"] for r in done.groupBy("source_domain", "split").count().collect()} == {(d, s): n for d in "AB" for s, n in zip(split.SPLITS, (80, 10, 10))}
    assert split.leakage(done).count() == 0
    assert split.leakage(done.withColumn("sha256", F.lit("same"))).first().splits == 3


def test_split_costs_are_plain_double_sums():
    """Costs are added as SQL adds them, term by term: where two splits' costs are equal so, the hash decides."""

    def serial(groups, plain):
        n, out = len(groups), {}
        floor = {"TRAIN": 1, "VALIDATION": 2 if n >= 20 else 1, "TEST": 2 if n >= 20 else 1}
        want = [split._whole(sum(s for _, s in groups)), {s: max(k, floor[s]) for s, k in split._whole(n).items()}]
        have = [dict.fromkeys(split.SPLITS, 0), dict.fromkeys(split.SPLITS, 0)]
        for at, (g, size) in enumerate(sorted(groups, key=lambda g: (split._hash(split.SEED, g[0]), g[0]))):
            unmet = {s: max(0, floor[s] - have[1][s]) for s in split.SPLITS}
            open_ = [s for s in split.SPLITS if unmet[s]] if sum(unmet.values()) > n - at - 1 else split.SPLITS

            def cost(to):
                images, counts = ([((h[s] + more * (s == to) - w[s]) / max(1, w[s])) ** 2 for s in split.SPLITS] for h, w, more in zip(have, want, (size, 1)))
                add = (lambda x: x[0] + x[1] + x[2]) if plain else sum
                return add(images) + split.GROUP_WEIGHT * add(counts)

            to = min(open_, key=lambda s: (cost(s), split._hash(split.SEED, g, s)))
            out[g] = to
            have[0][to] += size
            have[1][to] += 1
        return out

    strata = [[(f"{seed}-{i}", 1 + (i % 7 == 0)) for i in range(150 + seed)] for seed in range(12)]
    assert all(split.allocate(s) == serial(s, True) for s in strata)
    assert any(serial(s, True) != serial(s, False) for s in strata)  # the strata tell the two sums apart, where sum() keeps lost bits (Python 3.12 on)


def test_weights(spark):
    rows = spark.createDataFrame([("a",)] * 90 + [("b",)] * 9 + [("c",)], "label string")
    got = {r.label: r for r in weights.class_weights(rows, "label").collect()}
    raw = {k: math.sqrt(9 / n) for k, n in (("a", 90), ("b", 9), ("c", 1))}
    scale = 100 / sum(n * raw[k] for k, n in (("a", 90), ("b", 9), ("c", 1)))
    assert all(math.isclose(got[k].weight, raw[k] * scale) for k in raw) and got["c"].clipped == 3.0
    values = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4, None)], "g string, v int")
    assert weights.upper_median(values, "g", "v").first().upper_median == 3
    assert weights.histogram_quantiles(values, "v", (0.5,)).first().value == 2
    assert weights.summary(rows.limit(0).groupBy("label").agg(F.count("*").alias("n"))).first().ratio is None


def test_metrics(spark):
    rng = np.random.default_rng(1)
    t, a, b = (rng.integers(0, 4, 300) for _ in range(3))
    rows = spark.createDataFrame([(int(x), int(y), int(z)) for x, y, z in zip(t, a, b)], "t int, a int, b int")
    got = {r.c: r for r in metrics.per_class(rows.select("t", F.col("a").alias("p"))).collect()}
    for c in range(4):
        hit = ((t == c) & (a == c)).sum()
        assert math.isclose(got[c].precision, hit / (a == c).sum()) and math.isclose(got[c].recall, hit / (t == c).sum())
    classes = spark.range(6).select(F.col("id").cast("int").alias("c"))
    full = metrics.per_class(rows.select("t", F.col("a").alias("p")), classes)
    assert full.where("c = 5").first()[1:] == (0, 0, 0.0, 0.0, 0.0)
    assert metrics.averages(full).first().classes == 4
    out = metrics.paired_bootstrap(rows, 400).first()
    assert math.isclose(out.point_accuracy, (b == t).mean() - (a == t).mean())
    assert out.macro_ci[0] < out.point_macro < out.macro_ci[1]
    assert metrics.paired_bootstrap(rows, 400).first() == out
    assert metrics.paired_bootstrap(rows.limit(0)).count() == 0
    assert spark.range(1).select(metrics.argmax(F.array(F.lit(1), F.lit(3), F.lit(3)))).first()[0] == 1


def serial_plateau(xs, rate, factor, patience, cooldown, least, delta=1e-4):
    best, wait, cool = math.inf, 0, 0
    for x in xs:
        if cool > 0:
            cool -= 1
            wait = 0
        if x < best - delta:
            best, wait = x, 0
        elif cool <= 0:
            wait += 1
            if wait >= patience and rate > least:
                rate, cool, wait = max(rate * factor, least), cooldown, 0
    return best, wait, cool, rate


def test_replay(spark):
    rng = random.Random(2)
    series = {k: [rng.random() for _ in range(rng.randint(1, 25))] for k in range(20)}
    rows = spark.createDataFrame([(k, i + 1, x) for k, xs in series.items() for i, x in enumerate(xs)], "k int, epoch int, x double")
    for r in replay.replay_plateau(rows, "k", "epoch", "x", 1.0, 0.5, 2, 2, 0.05).collect():
        assert (r.best, r.wait, r.cooldown, r.rate) == pytest.approx(serial_plateau(series[r.k], 1.0, 0.5, 2, 2, 0.05))
    h = spark.createDataFrame([("a", 1, 0.5, 1.0), ("a", 2, 0.7, 0.5), ("b", 1, 0.9, 1.0), ("b", 3, 0.9, 1.0), ("c", 1, 0.5, float("nan"))], "k string, epoch int, val_macro_f1 double, val_loss double")
    plan = {r.k: r.plan for r in replay.resume_plan(replay.history_audit(h, "k"), 5).collect()}
    assert plan == {"a": "RESUME", "b": "RESTART", "c": "RESTART"}
    assert [r.k for r in replay.epoch_gaps(h, "k").collect()] == ["b"]


def test_activity(spark):
    rows = spark.createDataFrame([(i, 1, i, "Late" if i < 2 else "Early", s, 50.0) for i, s in enumerate(["diseased", "diseased", "diseased", "healthy", "healthy", "uncertain", "no_leaf"])] + [(9, 2, 9, "x", "healthy", 1.0)], "id int, user_id int, created_at int, disease string, status string, confidence double")
    one = activity.dashboard(activity.own_rows(rows, 1)).first()
    assert (one.total, one.healthy, one.diseased, one.uncertain, one.no_leaf) == (7, 2, 3, 1, 1)
    assert [(r.disease, r.n) for r in activity.frequent(rows).orderBy("rank").collect()] == [("Late", 2), ("Early", 1)]
    assert [r.id for r in activity.page(activity.own_rows(rows, 1), 2, 5).collect()] == [1, 0]
    assert activity.page(rows, 9).count() == 0
    crops = spark.createDataFrame([("Late",), ("Bell pepper",)], "crop string")
    labels = spark.createDataFrame([("Late blight",), ("Later",), ("Bell pepper spot",)], "label string")
    assert {r.crop: r.n for r in activity.prefix_classes(labels, crops).collect()} == {"Late": 1, "Bell pepper": 1}


def test_checks(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    with pytest.raises(checks.CheckFailed, match="known: 1"):
        checks.require(rows, {"known": F.col("v") > 0})
    for bad in (lambda: checks.require_rows(rows.limit(0)), lambda: checks.require_columns(rows, ("z",)), lambda: checks.require_unique(rows.unionAll(rows), "k"), lambda: checks.looked_up(rows, rows.limit(1).withColumnRenamed("v", "w"), "k", "w"), lambda: checks.merged_maps(rows, rows, "k")):
        with pytest.raises(checks.CheckFailed):
            bad()


def test_files(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text('dataset,hash,extra\nA,0000000000000012,"x, ""y"""\nB,,\n')
    rows = files.read_csv(spark, str(source), ("dataset", "hash"))
    assert [tuple(r) for r in rows.orderBy("dataset").collect()] == [("A", "0000000000000012", 'x, "y"'), ("B", "", "")]
    with pytest.raises(checks.CheckFailed):
        files.read_csv(spark, str(source), ("absent",))
    files.write_csv(rows, str(tmp_path / "out"), ("hash", "dataset"), "dataset")
    assert files.read_csv(spark, str(tmp_path / "out"), ("dataset",)).columns == ["hash", "dataset"]
    mapping = tmp_path / "map.json"
    mapping.write_text(json.dumps({"l1": {"status": "MATCHED", "target_class": "x"}, "l2": {"status": "AMBIGUOUS", "reason": "why"}}))
    assert files.read_mapping(spark, str(mapping)).count() == 2
    mapping.write_text(json.dumps({"l1": {"status": "MATCHED"}}))
    with pytest.raises(checks.CheckFailed):
        files.read_mapping(spark, str(mapping))
    table = spark.createDataFrame([("a", "0" * 16)], "k string, v string")
    calls = []

    def build(keyed):
        calls.append(1)
        return keyed.withColumn("v", F.lit("f" * 16))

    for expected in (1, 1):
        files.cached(spark, str(tmp_path / "cache"), table.select("k"), build, "k", "v")
        assert len(calls) == expected
    files.cached(spark, str(tmp_path / "cache"), spark.createDataFrame([("b",)], "k string"), build, "k", "v")
    assert len(calls) == 2
    files.write_splits(table.withColumn("split", F.lit("TEST")), str(tmp_path / "splits"))
    assert (tmp_path / "splits" / "split=TEST").is_dir()
    paths = spark.createDataFrame([("a/b",), ("../x",)], "source_path string")
    none = spark.createDataFrame([], "source_path string, local_file string")
    with pytest.raises(checks.CheckFailed):
        files.resolved_paths(paths, none)
    assert files.resolved_paths(paths.limit(1), none).first().resolved == "a/b"


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("blight/orig_1.png", b"\x89PNG\r\n\x1a\nrest")
        z.writestr("blight/aug_1.png", b"x")
    members = archives.zip_members(spark, str(tmp_path), "orig_")
    assert archives.verified_members(members, spark.createDataFrame([("blight", 1)], "label string, n long")).count() == 1
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../orig_2.png", b"x")
    with pytest.raises(checks.CheckFailed):
        archives.verified_members(archives.zip_members(spark, str(tmp_path), "orig_"))
    bodies = spark.createDataFrame([(bytearray(b"\xff\xd8\xffxx"),), (bytearray(b"no"),), (None,)], "content binary")
    assert sorted(r.ok for r in archives.decode_test(bodies).collect())[0] is False


def test_streams(spark, tmp_path):
    for i, part in enumerate([[(0, 0), (0, 1)], [(1, 1), (0, 0)]]):
        spark.createDataFrame(part, "t int, p int").write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("t int, p int").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = histories.confusion_stream(stream).writeStream.format("memory").queryName("cells").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination()
    f1 = histories.macro_f1(spark.table("cells"), 3).first().macro_f1
    assert math.isclose(f1, (2 * 2 / 5 + 2 * 1 / 3) / 3)
    spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 2)], "key string, epoch int").write.parquet(str(tmp_path / "h"))
    rows = spark.readStream.schema("key string, epoch int").parquet(str(tmp_path / "h"))
    histories.append_history(histories.sequence_checked(rows), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    got = {(r.key, r.epoch): r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1): True, ("a", 2): True, ("a", 4): False, ("b", 2): False}
