"""Final columns of every query over sf0.001 against plain Python that shares no code with the operators, and each pipeline stage against brute force."""

import hashlib
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import PII, brute_contamination, brute_lines, connected

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline
from quern.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def rows_of(spark, name):
    return queries.queries()[name](spark, SF).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def fingerprint(text):
    """Bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(texts):
    """doc_id -> least doc_id reachable over fingerprints of two differing bits at most."""
    fps = {d: fingerprint(t) for d, t in texts.items()}
    ids = sorted(fps)
    return fps, connected(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])


def test_op1(spark):
    kinds = [("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]
    texts = {d["doc_id"]: d["text"] or "" for d in table("documents")}
    got = rows_of(spark, "op1_crf_secret_scan")
    assert len(got) == len(texts)
    for r in got:
        found = sorted((m.start(), o, m.end(), k) for o, (k, p, g, least) in enumerate(kinds) for m in p.finditer(texts[r.doc_id]) if len(m[g]) >= least)
        base = [f"{k}:{a}:{b}" for a, _, b, k in found]
        spans = r.spans.split(",") if r.spans else []
        assert r.base_sha256 == sha(",".join(base)) and [s for s in spans if not s.startswith("crf")] == base
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_op2(spark):
    texts = {d["doc_id"]: d["text"] for d in table("documents")}
    fps, root = groups_of(texts)
    got = rows_of(spark, "op2_simhash_near_dedup")
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{fps[d]:016x}", root[d]) for d in texts} and len(got) == len(texts)


def test_op3(spark):
    docs, items = table("documents"), [(b["item_id"], b["text"]) for b in table("benchmark")]
    got = {r.doc_id: tuple(r)[1:] for r in rows_of(spark, "op3_benchmark_decontamination")}
    want = brute_contamination([d["text"] for d in docs], items)
    assert got == {d["doc_id"]: w for d, w in zip(docs, want)}


@pytest.mark.parametrize("name, bound", [("op4_additive_quality", 0.5), ("op10_toxicity", 0.7)])
def test_scores(spark, name, bound):
    docs = table("documents")
    got = {r.doc_id: r for r in rows_of(spark, name)}
    assert set(got) == {d["doc_id"] for d in docs}
    for d, r in got.items():
        assert r.held_out == held_out(d) and 0 <= r.score <= 1 and r.predicted == int(r.score >= bound)


def test_additive_scores_are_sums_of_table_entries():
    """Row by row, entry by entry, against the vectorised sum."""
    rng = np.random.default_rng(3)
    x = rng.random((500, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3) ^ (rng.random(500) < 0.1)).astype(float)
    model = quality.fit(x, y)
    for row, p in zip(x[:60], model.predict(x)[:60]):
        at = [sum(row[j] >= e for e in edges) for j, edges in enumerate(model.edges)]
        z = model.base + sum(t[b] for t, b in zip(model.tables, at)) + sum(t[at[i]][at[j]] for i, j, t in model.pairs)
        assert p == pytest.approx(1 / (1 + np.exp(-z)))


def test_scores_do_not_hang_on_conflicting_labels_or_repeated_rows(spark):
    docs = spark.createDataFrame([(i, "good plain words here " * 3 if i % 2 else "bad grobnik zentulal words " * 3) for i in range(60)], "doc_id long, text string").withColumns({c: F.lit(c) for c in ("score", "predicted", "held_out", "x", "row")})
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)] + [(i, 1 - i % 2, i % 2) for i in range(10)], "doc_id long, quality int, toxic int")
    clean = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(10, 60)], "doc_id long, quality int, toxic int")
    for f in (lambda d, l: toxicity.toxicity(d, d, l), lambda d, l: quality.quality(d, l)):
        a, b = f(docs, labels), f(docs.unionAll(docs.where("doc_id < 30")), clean)
        assert {(r.doc_id, r.score) for r in a.collect()} == {(r.doc_id, r.score) for r in b.collect()} and b.count() == 90
        assert all(r.x == "x" and r.row == "row" for r in a.collect()) and dict(a.dtypes)["score"] == "double" and len(a.columns) == len(set(a.columns))
    kept = toxicity.keep_clean(docs, docs, labels)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {"score"}


def test_op5(spark):
    texts = {d["doc_id"]: d["text"] or "" for d in table("documents")}
    got = rows_of(spark, "op5_weak_supervision_pii")
    assert len(got) == len(texts)
    for r in got:
        base = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in PII for m in p.finditer(texts[r.doc_id]) if ok(m[0])]
        assert r.base_sha256 == sha(",".join(base)) and r.spans.split(",")[: len(base)] == (base or r.spans.split(",")[:0])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k + ":") for s in base) for k in ("email", "ip", "card", "phone"))


def test_op6(spark):
    docs = {d["doc_id"]: d["text"] for d in table("documents")}
    got = {r.doc_id: r for r in rows_of(spark, "op6_fuzzy_line_dedup")}
    want = dict(brute_lines_fast(docs))
    lost = sum(len((got[d].text or "").split("\n")) != len((t or "").split("\n")) for d, t in want.items())
    assert set(got) == set(docs) and lost <= 0.01 * len(docs)
    assert all(r.n_lines == (0 if docs[d] is None else docs[d].count("\n") + 1) for d, r in got.items())
    assert all(r.text is None or r.text.count("\n") + 1 == r.n_lines - r.n_dropped or r.n_dropped == r.n_lines for r in got.values())


def brute_lines_fast(docs):
    """brute_lines, comparing lines of like size alone."""
    return brute_lines_sized(sorted(docs.items()))


def brute_lines_sized(rows):
    keyed = {(d, i, t): l for d, t in rows if t is not None for i, l in enumerate(t.split("\n")) if l.strip()}
    norm = {k: re.sub(r"\s+", " ", l.lower()).strip() for k, l in keyed.items()}
    sets = {n: frozenset(n[i : i + 5] for i in range(max(1, len(n) - 4))) for n in set(norm.values())}
    names = sorted(sets, key=lambda n: len(sets[n]))
    near = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if 0.8 * len(sets[b]) > len(sets[a]):
                break
            shared = len(sets[a] & sets[b])
            if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                near.append((a, b))
    group = connected(list(sets), near)
    first = {}
    for k in sorted(keyed):
        first.setdefault(group[norm[k]], k)
    return [(d, None if t is None else "\n".join(l for i, l in enumerate(t.split("\n")) if (d, i, t) not in keyed or first[group[norm[d, i, t]]] == (d, i, t))) for d, t in rows]


def test_brute_forces_agree():
    rows = [(1, "alpha bravo charlie delta echo\nx"), (2, "alpha bravo charlie delta echos\n X "), (3, None), (4, "own")]
    assert brute_lines(rows) == brute_lines_sized(rows) == [(1, rows[0][1]), (2, ""), (3, None), (4, "own")]


def test_op7(spark):
    pages = {p["page_id"]: p for p in table("pages")}
    got = rows_of(spark, "op7_host_suffix_html")
    assert {(r.page_id, r.url) for r in got} == {(i, p["url"]) for i, p in pages.items()} and len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id]["html"], re.S)[1]
        plain = re.sub(r"<(/?)(?:b|i|em|strong|a|span)\b[^>]*>", "", re.sub(r"<(?:script|style)\b.*?</(?:script|style)>", "", inside, flags=re.S))
        import html

        assert r.text.split() == html.unescape(re.sub(r"<[^>]*>", " ", plain)).split() and r.n_chars == len(r.text)


def test_op8(spark):
    vectors = {v["vec_id"]: np.array(v["embedding"], np.float64) for v in table("embeddings") if v["embedding"] is not None}
    got = {}
    for r in rows_of(spark, "op8_anisotropic_search"):
        assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), abs=1e-9) and r.query_id % 20 == 0 and r.query_id != r.vec_id
        got.setdefault(r.query_id, {})[r["rank"]] = (-r.score, r.vec_id)
    hits = 0
    for q, found in got.items():
        best = sorted((-float(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:20]
        assert [found[i] for i in range(1, 21)] == sorted(found.values())
        hits += len({i for _, i in best} & {i for _, i in found.values()})
    assert set(got) == {i for i in vectors if i % 20 == 0} and hits >= 0.9 * 20 * len(got)


def whole_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole_ids.tok = getattr(whole_ids, "tok", None) or Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    return np.array(whole_ids.tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def check_packing(rows, texts):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        ids = whole_ids(texts[d])
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in sorted(own, key=lambda r: r.piece)] == [(i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for i, s in enumerate(range(0, len(ids), 2048))]
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.02 * total / 2048 + 1


def test_op9(spark):
    check_packing(rows_of(spark, "op9_best_fit_packing"), {d["doc_id"]: d["text"] for d in table("documents")})


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, against plain Python over the same rows."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def run(name, docs):
        stages[name](spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        return out, {r.doc_id: r.text for r in out.select(*[c for c in ("doc_id", "text") if c in out.columns]).collect()} if "text" in out.columns else None

    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    reader = model.scorer()
    before = {r.doc_id: r.text for r in docs.collect()}
    clean, kept = run("toxicity", docs)
    z = {d: float(reader.features(t) @ model.weights) for d, t in before.items()}
    assert kept == {d: t for d, t in before.items() if 1 / (1 + np.exp(-z[d])) < 0.7}

    fewer, texts = run("line_dedup", clean)
    want = {d: t for d, t in brute_lines_sized(sorted(kept.items())) if t == kept[d] or t.strip()}
    assert len(set(texts.items()) ^ set(want.items())) <= 0.01 * len(want)

    single, first = run("simhash_near_dedup", fewer)
    _, root = groups_of(texts)
    assert first == {d: t for d, t in texts.items() if root[d] == d}

    away, left = run("benchmark_decontamination", single)
    items = [(b["item_id"], b["text"]) for b in table("benchmark")]
    hit = brute_contamination(list(first.values()), items)
    assert left == {d: t for (d, t), h in zip(first.items(), hit) if not h[-1]}
    check_packing(stages["best_fit_packing"](spark, away, SF).collect(), left)


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and texts, repeats, clashing names and empty tables at every stage; a contaminated row goes with a null id as well."""
    passage = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november"
    names = "score row d t v drop label component_id contaminated n_dropped".split()
    rows = [(None, passage), (None, "clean and null"), (1, passage + " more"), (2, None), (2, None), (3, ""), (4, "own words of this row"), (4, "own words of this row"), (5, "x" * 30_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit(n) for n in names})
    sf = str(tmp_path)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() > 0, name
        assert all(r[n] == n for r in out.collect() for n in names), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    left = corpus_pipeline.drop_contaminated(spark, docs, sf).collect()
    assert len(left) == 7 and sum(r.doc_id is None for r in left) == 1
    assert corpus_pipeline.pack_sequences(spark, docs, sf).where("piece = 0").count() == len(rows)
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), sf).count() == 0
