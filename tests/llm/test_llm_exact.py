"""The corpus operators against brute force, exact round trips and held-out accuracy."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import ann, linededup, minhash, neardup_vectors, packing, quality, segment, sharding, tokens, toxicity, warc
from cohortlens.llm.common import components, mix
from cohortlens.llm.registry import table

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return dict(docs.select("doc_id", "text").collect())


# --- shared --------------------------------------------------------------------------


def closure(pairs, nodes):
    """Smallest reachable node, by repeated merging."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(900, 901 + i) for i in range(50)]
    got = dict(components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect())
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == closure([p for p in pairs if p[0] != p[1]], nodes)


# --- 1 ---------------------------------------------------------------------------------


def test_weights_and_growth(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    shards = {0: 1.0, 1: 2.0, 2: 1.0}
    before = dict(sharding.assign(df, "doc_id", shards).collect())
    share = Counter(before.values())
    assert abs(share[1] / 20_000 - 0.5) < 0.02 and abs(share[0] / 20_000 - 0.25) < 0.02
    both = sharding.assign(df, "doc_id", shards, {3: 1.0}).collect()
    after = dict(sharding.assign(df, "doc_id", {**shards, 3: 1.0}).collect())
    assert all(r["grown_shard"] == after[r["doc_id"]] and r["shard"] == before[r["doc_id"]] for r in both)
    moved = [k for k in before if before[k] != after[k]]
    assert {after[k] for k in moved} == {3} and abs(len(moved) / 20_000 - 0.2) < 0.02


# --- 2 ---------------------------------------------------------------------------------


def paths(lattices, node):
    if lattices.left[node] == 0:
        yield (), 0.0
        return
    for size in np.flatnonzero(lattices.p[node]):
        edge = node * lattices.wide + size
        for rest, logp in paths(lattices, int(lattices.ends(np.array([edge]))[0])):
            yield (int(edge), *rest), math.log(lattices.p[node, size]) + logp


def test_sampling_law():
    """Frequencies of the first and the second sample, and inclusion weights, against full enumeration."""
    import public_tokenizers

    voc = segment.vocabulary(public_tokenizers.path("piece_bpe_32k.model"), "rank", 0.3)
    runs = voc.split("in on")
    lattices = segment.Lattices(voc, runs)
    nodes = np.array([lattices.first[r] for r in runs])
    law = {sum((p for p, _ in c), ()): math.exp(sum(x for _, x in c)) for c in itertools.product(*[list(paths(lattices, int(n))) for n in nodes])}
    assert abs(sum(law.values()) - 1) < 1e-9
    n, k = 6000, 3
    seeds = mix(np.arange(n, dtype=np.uint64))
    within, own = np.tile(np.arange(len(nodes)), n).astype(np.uint64), np.repeat(seeds, len(nodes))
    free = [lattices.draw(np.tile(nodes, n), mix(own ^ mix(within * np.uint64(k) + np.uint64(j)))) for j in range(k)]
    first, second, weight = Counter(), Counter(), Counter()
    for samples in segment.top_k(lattices, free, np.arange(n + 1) * len(nodes), k, seeds):
        keys = [tuple(e.tolist()) for e, *_ in samples]
        assert len(set(keys)) == min(k, len(law))
        assert [g for *_, g, _ in samples] == sorted((g for *_, g, _ in samples), reverse=True)
        first[keys[0]] += 1
        second[keys[1]] += 1
        for key, (_, logp, _, inclusion) in zip(keys, samples):
            assert abs(math.exp(logp) - law[key]) < 1e-9
            weight[key] += 1 / inclusion
    for key, p in law.items():
        q = sum(law[a] * p / (1 - law[a]) for a in law if a != key)
        assert abs(first[key] / n - p) < 0.03 and abs(second[key] / n - q) < 0.03
        if p > 0.05:
            assert abs(weight[key] / n - 1) < 0.1


def test_segmentations_decode_and_do_not_depend_on_partitions(docs, texts):
    out = segment.segmentations(docs.where("doc_id < 60"), k=2)
    rows = out.withColumn("text", segment.decoded("ids")).collect()
    assert all(r["text"] == texts[r["doc_id"]] for r in rows if "  " not in texts[r["doc_id"]])
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["ids"])
    assert len(by) == 60 and all(len(v) == 2 for v in by.values())
    again = segment.segmentations(docs.where("doc_id < 60").repartition(7), k=2).collect()
    assert sorted((r["doc_id"], r["sample"], r["ids"]) for r in again) == sorted((r["doc_id"], r["sample"], r["ids"]) for r in rows)


# --- 3 and 8 -----------------------------------------------------------------------------


def test_nearest_recall(spark):
    df = table(spark, DATA, "embeddings")
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    got = ann.nearest(df).collect()
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        score = (x * x[ids == q][0]).sum(axis=1)
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert all(abs(r["score"] - score[ids == r["vec_id"]][0]) < 1e-12 for r in own)
        hits += len({r["vec_id"] for r in own} & set(ids[best].tolist()))
        total += 20
    assert hits / total >= 0.9
    # The same through many small blocks.
    small = ann.nearest(df, row_block=100, query_block=10).collect()
    assert len(small) == len(got)


def test_nearest_recall_of_unequal_lengths(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    rng = np.random.default_rng(6)
    lone = np.where(ids == 7, 4.0, 1.0)
    for factor in (lone, np.where(rng.random(len(x)) < 0.01, 3.0, 1.0), np.exp(0.5 * rng.normal(size=len(x)))):
        y = x * factor[:, None]
        df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, y)], "vec_id bigint, embedding array<double>")
        got = {}
        for r in ann.nearest(df).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        best = {q: [i for i in ids[np.lexsort((ids, -(y @ y[ids == q][0])))] if i != q][:20] for q in ids[ids % 20 == 0].tolist()}
        assert sum(len(got[q] & set(b)) for q, b in best.items()) / sum(map(len, best.values())) >= 0.95


def test_near_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(600, 24))
    near = base[rng.integers(0, 60, 500)] + rng.normal(size=(500, 24)) * 0.25
    x = np.concatenate([base, near, np.repeat(base[:1], 30, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    close = np.argwhere(np.triu(unit @ unit.T >= 0.9, 1))
    n = Counter(close.ravel().tolist())
    block = neardup_vectors.BLOCK
    try:
        neardup_vectors.BLOCK = 40  # hot cells take part in many blocks
        rows = {r["vec_id"]: r for r in neardup_vectors.near_duplicates(df, centres=4).collect()}
    finally:
        neardup_vectors.BLOCK = block
    found = sum(r["n_links"] for r in rows.values())
    assert found >= 0.99 * 2 * len(close) and all(r["n_links"] <= n[i] for i, r in rows.items())
    whole = closure([tuple(map(int, p)) for p in close], range(len(x)))
    assert sum(rows[i]["component_id"] == whole[i] for i in rows) >= 0.99 * len(x)


# --- 4 ---------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abAB's12 \n\t.,!?éÀß½²ªµ<|>'t\xa0\x85\x1c☃中İſ'lls"), st.characters()), max_size=40))
def test_ids_are_the_tokenizers(text):
    words = tokens.word_ids(tokens.tokenizer_path())
    text = text.encode("utf-8", "ignore").decode()
    given_ = [None, text, "", "the " + text, "One, two."]
    for portion in (pa.array(given_), pa.array(["sliced off", *given_])[1:]):
        ids, ends = words.encode(portion)
        for t, low, high in zip(given_, ends, ends[1:]):
            assert ids[low:high].tobytes() == words.whole(t or "")


def test_pieces_and_packing(docs, texts):
    rows = packing.pack_documents(docs, with_ids=True).collect()
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
    tokenizer = tokens.word_ids(tokens.tokenizer_path())
    for key, text in texts.items():
        own = sorted(by[key], key=lambda r: r["piece"])
        assert b"".join(r["ids"] for r in own) == tokenizer.whole(text) + (1).to_bytes(4, "little")
        assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in own)
        assert [r["start"] for r in own] == [4096 * i for i in range(len(own))] and all(r["length"] == 4096 for r in own[:-1])
    for own in seq.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(r["length"] for r in own[:i]) for i in range(len(own))]
        assert sum(r["length"] for r in own) <= 4096
    assert len(seq) <= 1.02 * math.ceil(sum(r["length"] for r in rows) / 4096)


def test_packing_does_not_depend_on_the_order_of_rows(docs):
    columns = ["doc_id", "piece", "sequence_id", "offset"]
    packed = [sorted(map(tuple, packing.pack_documents(d).select(columns).collect())) for d in (docs, docs.repartition(7, "source"), docs.orderBy(F.desc("n_chars")))]
    assert packed[0] == packed[1] == packed[2]


def test_sum_of_squares_rule():
    """Each placement lowers the sum of squared gap counts as far as any other would."""
    rng = np.random.default_rng(1)
    sizes, capacity = rng.integers(1, 21, 300), 20
    bins, offsets = packing.sum_of_squares(sizes, capacity)
    used = {}
    for s, b, o in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        def after(bin_):
            now = {**used, bin_: used.get(bin_, 0) + s}
            return sum(n * n for g, n in Counter(capacity - u for u in now.values()).items() if 0 < g < capacity)

        options = [after(x) for x in used if used[x] + s <= capacity] + [after(-1)]
        assert used.get(b, 0) == o and after(b if b in used else -1) == min(options)
        used[b] = o + s
    assert max(used.values()) <= capacity


# --- 5 and 7 -----------------------------------------------------------------------------


@pytest.mark.parametrize("kind, label, least", [(toxicity, "toxic", 0.85), (quality, "quality", 0.97)])
def test_held_out_accuracy(spark, kind, label, least):
    folder = "/root/testdata/sf0.1"
    labels = table(spark, folder, "labels")
    rows = kind.score_documents(table(spark, folder, "documents"), labels).collect()
    truth = dict(labels.select("doc_id", label).collect())
    judged = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    rare = 1 if label == "toxic" else 0
    found = sum(p == t == rare for p, t in judged) / sum(t == rare for _, t in judged)
    false = sum(p == rare != t for p, t in judged) / sum(t != rare for _, t in judged)
    assert found >= least and false <= 0.02
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_machine_learns_pairs():
    """Neither of two terms alone is toxic, both together are: no additive score can tell."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array(sorted({*([11] if a else []), *([12] if b else []), int(rng.integers(100, 140))}), dtype=np.int64))
        labels.append(int(a != b))
    m = toxicity.fit(np.array(labels), rows, terms=64, epochs=120)
    place = m.position
    score = {k: m.score([place[s] for s in k]) for k in ((), (11,), (12,), (11, 12))}
    assert min(score[(11,)], score[(12,)]) > max(score[()], score[(11, 12)])


# --- 6 ---------------------------------------------------------------------------------


def filled(text):
    return [x.strip() for x in (text or "").split("\n") if x.split()]


def sure_runs(lines, words):
    out = set()
    for i in range(len(lines)):
        n = 0
        for j in range(i, len(lines)):
            n += len(lines[j].split())
            if n >= words:
                out.add(tuple(lines[i : j + 1]))
                break
    return out


def check_lines(rows, texts):
    seen, lines = set(), set()
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        before, after = filled(texts[r["doc_id"]]), filled(r["text"])
        assert not (Counter(after) - Counter(before))
        assert not sure_runs(after, linededup.SURE_WORDS) & seen, "a run that stood earlier is left"
        assert all(x in lines or x in after for x in before), "a line without an earlier place is gone"
        if r["lines_deleted"] == 0:
            assert r["text"] == texts[r["doc_id"]]
        seen |= sure_runs(before, linededup.SURE_WORDS)
        lines |= set(before)


def test_line_dedup(docs, texts):
    rows = linededup.dedup_lines(docs).collect()
    check_lines(rows, texts)
    assert sum(r["lines_deleted"] for r in rows) > 0


def test_line_dedup_small(spark):
    def words(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    p = "\n".join(words(c, 12) for c in "pqrs")
    docs = {0: f"{words('a', 30)}\n{p}\n{words('b', 5)}", 1: f"{words('c', 9)}\n{p}\nend", 2: words("p", 12), 3: f"{words('p', 12)}\n\n  {words('q', 12)}  \n{words('r', 12)}\n{words('s', 12)}", 4: f"{p}\n{p}"}
    rows = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()}
    assert rows == {0: docs[0], 1: f"{words('c', 9)}\nend", 2: docs[2], 3: "", 4: ""}


def test_line_dedup_takes_whole_passages(spark):
    """Copies of a passage go entirely, also when lines of it stood earlier on their own."""
    def words(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    docs, after = {}, {}
    for c in range(24):  # whichever of a passage's grams have the smallest hash
        a, b, d = words(f"a{c}_", 18), words(f"l{c}_", 22), words(f"b{c}_", 15)
        passage = f"{a}\n{b}\n{d}"
        # Alone before the passage, with a line so short that only the gram of the middle line can be selected.
        for i, (text, kept) in enumerate(((f"{b}\n{words(f'x{c}_', 19)}", None), (passage, None), (passage, ""), (f"end\n{passage}\nend", "end\nend"))):
            docs[10 * c + i] = text
            if kept is not None:
                after[10 * c + i] = kept
    rows = linededup.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()
    check_lines(rows, docs)
    assert {r["doc_id"]: r["text"] for r in rows if r["doc_id"] in after} == after


# --- 9 ---------------------------------------------------------------------------------


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({i: i + 32 for i in range(65, 91)}) if text else "")
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_minhash_in_blocks(spark):
    """One crowded bucket of near copies, worked off in many blocks, against all pairs."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 7)):
            words[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"v{i}_{j}" for j in range(30))) for i in range(20)]
    old = minhash.BUCKET_BLOCK, minhash.GROUP_BLOCK
    try:
        minhash.BUCKET_BLOCK, minhash.GROUP_BLOCK = 40, 25
        got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), n=4).collect()}
    finally:
        minhash.BUCKET_BLOCK, minhash.GROUP_BLOCK = old
    sets = {i: shingle_set(t, 4) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closure(pairs, sets)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_estimate_is_collision_corrected():
    rng = np.random.default_rng(6)
    for share in (0.2, 0.5, 0.8):
        est = []
        for _ in range(60):
            common, n = rng.integers(0, 2**63, 1000, dtype=np.uint64), int(1000 * (1 - share) / (2 * share))
            a = np.unique(np.concatenate([common, rng.integers(0, 2**63, n, dtype=np.uint64)]))
            b = np.unique(np.concatenate([common, rng.integers(0, 2**63, n, dtype=np.uint64)]))
            sig = [np.frombuffer(minhash.packed(minhash.minima(x)), dtype=np.uint64)[None] for x in (a, b)]
            c = 2.0**-minhash.BITS
            est.append((minhash.equal_minima(*sig)[0, 0] / minhash.MINIMA - c) / (1 - c))
        assert abs(np.mean(est) - share) < 0.03


# --- 10 --------------------------------------------------------------------------------


def test_archive_is_dictionary_compressed(spark):
    import zstandard
    from pyarrow import fs

    pages = table(spark, DATA, "pages")
    folder = warc.archive_folder(spark)
    archives = warc.write(pages, folder)
    back = {r["page_id"]: r for r in warc.read(archives, folder).collect()}
    assert all(bytes(back[r["page_id"]]["payload"]) == r["html"].encode() for r in pages.collect())
    where, _ = fs.FileSystem.from_uri(folder)
    for r in archives.collect():
        data = where.open_input_stream(r["path"]).read()
        assert data[:4] == bytes.fromhex("5d2a4d18") and len(data) == r["bytes"]
        size = int.from_bytes(data[4:8], "little")
        content = data[8 : 8 + size]
        assert size == 0 or int.from_bytes(content[:4], "little") == 0xEC30A437
        # Every record is a frame of its own and needs nothing but the dictionary.
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if size else None)
        assert plain.decompressobj().decompress(data[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")


# --- pipeline ----------------------------------------------------------------------------


def test_pipeline_by_stages(spark, docs, texts):
    """Each stage against its rule, on its own input."""
    labels = table(spark, DATA, "labels")
    now = docs
    for (name, stage), rule in zip(corpus_pipeline.STAGES[:-1], ("toxicity", "quality", "lines", "near")):
        rows = spark.createDataFrame(stage(spark, now, DATA).collect(), docs.schema)
        before, after = dict(now.select("doc_id", "text").collect()), dict(rows.select("doc_id", "text").collect())
        if rule in ("toxicity", "quality"):
            kind = toxicity if rule == "toxicity" else quality
            model = kind.train(now, labels)
            score = dict(now.select("doc_id", kind.score(model, now["text"])).collect())
            assert after == {k: t for k, t in before.items() if (score[k] < 0.7 if rule == "toxicity" else score[k] >= 0.5)}
        elif rule == "lines":
            check_lines([r for r in linededup.dedup_lines(now).collect()], before)
            gone = set(before) - set(after)
            assert gone and all(filled(before[k]) for k in gone)
        else:
            sets = {k: shingle_set(t, 5) for k, t in before.items()}
            index = {}
            for k, s in sets.items():
                for x in s:
                    index.setdefault(x, []).append(k)
            shared = Counter(p for v in index.values() for p in itertools.combinations(sorted(v), 2))
            pairs = [p for p, n in shared.items() if 100 * n >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
            want = closure(pairs, sets)
            assert set(after) == {k for k in sets if want[k] == k}
        now = rows
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in now.collect()}
