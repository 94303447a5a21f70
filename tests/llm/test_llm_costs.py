"""What operators hold and how they look things up, beside plain computation."""

import re
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from cohortlens.llm import neardup_vectors, quality, segment, toxicity


def private_mb() -> float:
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.parametrize("module", [toxicity, quality])
def test_the_driver_gives_the_memory_of_a_sample_back(spark, monkeypatch, module):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('plain words ', id % 2, ' and ', id) AS text")
    labels = spark.range(40).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic", "CAST(id % 2 AS INT) AS quality")
    events = []
    fit, released = module.fit, module.released
    monkeypatch.setattr(module, "fit", lambda *a: events.append("fit") or fit(*a))
    monkeypatch.setattr(module, "released", lambda: events.append("released") or released())
    module.train(docs, labels)
    assert events == ["fit", "released"]


def test_released_memory_goes_back_to_the_machine():
    from cohortlens.llm.common import released

    released()
    before = private_mb()
    kept = [bytes([i % 256]) * 100_000 for i in range(1000)]
    assert private_mb() > before + 80
    del kept
    released()
    assert private_mb() < before + 40


def test_flags_are_counted_by_row():
    rng = np.random.default_rng(1)
    for shape in ((0, 16), (7, 8), (50, 16), (9, 24), (5, 13)):
        flags = rng.random(shape) < 0.4
        assert segment.counted(flags).tolist() == flags.sum(axis=1).tolist()


def test_pieces_are_found_by_their_hashes():
    voc = segment.vocabulary(public_tokenizers.path("piece_bpe_32k.model"), "rank", 1.0)
    assert voc.crowd > 1  # some hashes share their leading bits
    assert voc.find(voc.hashes).tolist() == list(range(len(voc.hashes)))
    near = np.concatenate([voc.hashes + np.uint64(1), voc.hashes ^ np.uint64(1 << 50), np.array([0, 2**64 - 1], dtype=np.uint64)])
    place = {int(h): i for i, h in enumerate(voc.hashes)}
    assert voc.find(near).tolist() == [place.get(int(h), -1) for h in near]


def test_shares_of_a_lattice_add_up():
    voc = segment.vocabulary(public_tokenizers.path("piece_bpe_32k.model"), "rank", 1.0)
    lattices = segment.Lattices(voc, ["▁segmentation", "▁of", "▁☃words", "a"])
    inner = lattices.left > 0
    wide = lattices.wide
    assert (lattices.cdf[inner, :wide] == np.cumsum(lattices.p[inner], axis=1, dtype=np.float32)).all()
    assert lattices.cdf.shape[1] % 8 == 0 and (lattices.cdf[:, wide:] > 1).all()
    assert lattices.choices.tolist() == (lattices.p > 0).sum(axis=1).tolist()


def test_equal_endings_are_one_node():
    voc = segment.vocabulary(public_tokenizers.path("piece_bpe_32k.model"), "rank", 1.0)
    runs = ["▁walking", "▁talking", "king", "☃" * 900 + "king", "a" + "☃" * 900 + "king", "▁" * 3]
    lattices = segment.Lattices(voc, runs)
    assert len(lattices.left) == len({r[i:] for r in runs for i in range(len(r) + 1)})
    inner = lattices.left > 0
    assert np.allclose(lattices.p[inner].sum(axis=1), 1.0, atol=1e-12)
    for run in runs:  # as in a lattice of its own
        alone, node = segment.Lattices(voc, [run]), lattices.first[run]
        own = alone.first[run]
        while lattices.left[node] > 0:
            assert np.allclose(lattices.p[node], alone.p[own], atol=1e-12) and (lattices.piece[node] == alone.piece[own]).all()
            node, own = int(lattices.after(np.array([node]), np.array([1]))[0]), int(alone.after(np.array([own]), np.array([1]))[0])


def test_paths_are_packed_together():
    voc = segment.vocabulary(public_tokenizers.path("piece_bpe_32k.model"), "rank", 1.0)
    runs = ["▁some", "☃\U0001f600é", "▁กwords"]
    lattices = segment.Lattices(voc, runs)
    owner, edges = lattices.draw(np.array([lattices.first[r] for r in runs]), np.arange(3, dtype=np.uint64))
    paths = [edges[owner == i] for i in range(3)]
    packed = lattices.packed([paths[0], edges[:0], paths[1], paths[2]])
    assert packed[1] == b"" and [voc.model.decode(np.frombuffer(b, "<u4").tolist()) for b in packed] == [r.replace("▁", " ").strip() for r in (runs[0], "", *runs[1:])]
    assert lattices.packed([]) == []


def test_lattices_look_up_only_what_may_be_a_piece(monkeypatch):
    voc = segment.vocabulary(public_tokenizers.path("piece_bpe_32k.model"), "rank", 1.0)
    runs = ["▁segmentations", "▁of", "▁xqzjvkwpyqzxjkvw", "▁of", "▁internationalization", "▁segmentations", "ß☃x"]
    asked, plain = [], voc.find
    monkeypatch.setattr(voc, "find", lambda hashes: asked.append(len(hashes)) or plain(hashes))
    lattices = segment.Lattices(voc, runs)
    pieces = int((lattices.piece >= 0).sum())
    assert sum(asked) < 2 * pieces < np.minimum(lattices.left, voc.longest).sum()
    assert lattices.starts.tolist() == [lattices.first[r] for r in runs]
    # Every substring that is a piece is an edge.
    known = {voc.model.id_to_piece(int(i)) for i in voc.id}
    for run in dict.fromkeys(runs):
        node, length = lattices.first[run], len(run)
        for at in range(length):
            found = {size + 1 for size in np.flatnonzero(lattices.piece[node] >= 0)}
            assert found == {size for size in range(1, min(voc.longest, length - at) + 1) if run[at : at + size] in known}
            node = int(lattices.on[node, 0])


def test_a_vector_is_sent_once_to_a_task_that_holds_cells_it_visits(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    sent, linked = [], neardup_vectors.linked
    monkeypatch.setattr(neardup_vectors, "linked", lambda placed, *a: sent.append(placed.count()) or linked(placed, *a))
    monkeypatch.setattr(neardup_vectors, "BLOCK", 100)
    neardup_vectors.near_duplicates(df, centres=4).count()
    # A cell that many visit is not cut into blocks that meet pair by pair, which sent 11,331.
    assert sent[0] <= 4 * 1200


@pytest.mark.parametrize("block", [7, 100, 10_000])
def test_links_count_once_wherever_vectors_meet(spark, monkeypatch, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 8))[rng.integers(0, 12, 400)] + rng.normal(size=(400, 8)) * 0.15
    rows = [(int(i // 2 * 2 if i % 10 == 1 else i), v.tolist()) for i, v in enumerate(x)]  # some ids with two vectors
    rows += [(1000 + i, [1.0, float(i) / 50]) for i in range(20)]  # and another length
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(neardup_vectors, "BLOCK", block)
    monkeypatch.setattr(neardup_vectors, "TILE", 64 * block)
    found = sorted((r["vec_id"], r["n_links"]) for r in neardup_vectors.near_duplicates(df, recall=1.0, centres=3).collect())
    want = Counter()
    for i, (a, v) in enumerate(rows):
        for b, w in rows[:i]:
            if len(v) == len(w) and np.dot(v, w) >= 0.9 * np.linalg.norm(v) * np.linalg.norm(w):
                want.update((a, b))
    # Both rows of an id bear the links of both.
    assert sum(n for _, n in found) > 2000
    assert all(n == want[i] for i, n in found)


def test_links_join_groups():
    rng = np.random.default_rng(2)
    for n, links in ((1, 0), (9, 4), (50, 45), (50, 400)):
        root, i, j = np.arange(n), rng.integers(0, n, links), rng.integers(0, n, links)
        new, told = neardup_vectors.united(root, i, j)
        whole, some = list(range(n)), list(range(n))
        for group, chosen in ((whole, range(links)), (some, told)):
            for at in chosen:
                a, b = sorted((group[i[at]], group[j[at]]))
                group[:] = [a if g == b else g for g in group]
        assert new.tolist() == whole == some and len(told) == n - len(set(whole))
