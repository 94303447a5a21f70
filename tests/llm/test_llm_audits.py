"""Turn repair, files of token ids and the filter audit against brute force, with their edge cases."""

import hashlib
import heapq
import itertools
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import filteraudit, minhash, simple8b, tokens, turnrepair, warc
from cohortlens.llm.registry import table

DATA = "/root/testdata/sf0.01"
CLASHES = ["key", "conv", "copy", "kind", "fault", "digest", "n", "mask", "part", "words", "at", "place", "A", "E", "good", "first"]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents")


# --- 11: turn repair ---------------------------------------------------------------------


def cheapest_by_search(kinds):
    """Least (cost, audit) over all sequences of edits, by best-first search."""
    queue, seen = [(0, "", 0, "")], set()
    while queue:
        cost, audit, at, roles = heapq.heappop(queue)
        if at == len(kinds) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, roles
        state = (at, {"": 0, "s": 1}.get(roles, 2 if roles.endswith("u") else 3))
        if state in seen or not re.fullmatch("s?(ua)*u?", roles):
            continue
        seen.add(state)
        if at < len(kinds):
            k = kinds[at]
            more = 5 if k.isupper() else 0
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, roles))
            if k != "d":
                if k.lower() != "x":
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, roles + k.lower()))
                for r in "ua":
                    heapq.heappush(queue, (cost + 1 + more, audit + "R", at + 1, roles + r))
        for r in "ua":
            heapq.heappush(queue, (cost + 5, audit + "I", at, roles + r))


def all_splits(kinds):
    """The same grammar with every split of every span."""
    cells = {(i, i + 1): turnrepair.TURNS[k] for i, k in enumerate(kinds)}
    for size in range(2, len(kinds) + 1):
        for i in range(len(kinds) - size + 1):
            cell = {}
            for j in range(i + 1, i + size):
                for symbol, value in turnrepair.join(cells[i, j], cells[j, i + size]).items():
                    turnrepair.better(cell, symbol, value)
            cells[i, i + size] = cell
    return cells[0, len(kinds)]


KINDS = st.text(alphabet="suaxSUAXd", max_size=9)


@settings(max_examples=400, deadline=None)
@given(KINDS)
def test_repair_is_the_cheapest(kinds):
    assert turnrepair.repair(kinds) == cheapest_by_search(kinds)


@settings(max_examples=100, deadline=None)
@given(KINDS.filter(bool))
def test_one_split_of_a_span_is_enough(kinds):
    assert turnrepair.parse(kinds) == all_splits(kinds)


def test_repair_of_long_conversations():
    assert turnrepair.repair("ua" * 5000) == (0, "K" * 10_000, "ua" * 5000)
    assert turnrepair.repair("d" * 999) == (1998, "D" * 999, "")


def by_hand(rows):
    """Result of each conversation from plain lists."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept, blank = [], re.compile(r"[^\x20\x09-\x0D]")
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            damage = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if damage:
                text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
                kept += [(turn, "user" if damage == 4 else role, text)] * (2 if damage == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        kinds, counts = "", [0, 0, 0]
        for i, (_, role, text) in enumerate(kept):
            k = role[:1] if role[:1] in ("s", "u", "a") else "x"
            if not blank.search(text):
                fault, k = 0, "d"
            elif any(r[1:] == (role, text) for r in kept[:i]):
                fault, k = 1, "d"
            elif re.findall(blank, text)[-1] not in ".!?":
                fault, k = 2, k.upper()
            else:
                fault = None
            if fault is not None:
                counts[fault] += 1
            kinds += k
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, roles = cheapest_by_search(kinds)
        lines, rest = [], iter(kept)
        for e in audit:
            row = None if e == "I" else next(rest)
            if e != "D":
                role = row[1] if e == "K" else {"u": "user", "a": "assistant"}[roles[len(lines)]]
                lines.append(f"{role}:{row[2] if row else ''}")
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_conversations(spark):
    rows = [tuple(r) for r in table(spark, DATA, "conversations").select("conv_id", "turn", "role", "text").collect()]
    odd = [(None, 0, "user", "No id."), (None, None, None, None), (7001, None, "system", "x."), (7001, 5, "User", "Long. " * 50_000), (7001, 5, "", "same"), (7001, 5, "", "same"),
           (7002, 0, "tool", "\t\n "), (7003, 3, "assistant", None), (7004, 1, "user", "ü☃"), (7004, 1, "user", "ü☃.")]
    odd += [(7100, t, "user" if t % 3 else "assistant", f"Turn {t % 40}{'.' if t % 7 else ''}") for t in range(300)]
    dropped = next(i for i in range(8000, 9000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [*odd, (dropped, 0, "user", "All rows of this one are dropped.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5).withColumns({c: F.lit("x") for c in CLASHES})
    got = {r[0]: tuple(r)[1:] for r in turnrepair.repair_conversations(df).collect()}
    assert got == by_hand(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert turnrepair.repair_conversations(df.limit(0)).count() == 0


def test_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi!"), (2, 0, "user", "Yes?"), (2, 1, "user", "No.")], "conv bigint, turn bigint, role string, text string").withColumn("copy", F.lit(0))
    rows = turnrepair.repaired(df, turnrepair.parsed(df)).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "user", "Hello."), (1, 1, "assistant", "Hi!"), (2, 0, "user", "Yes?"), (2, 1, "assistant", "No.")]


# --- 12: files of token ids --------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 49_407), st.integers(0, 2**64 - 1)), min_size=1, max_size=150), max_size=6))
def test_words_round_trip(blocks):
    ends = np.cumsum([len(b) for b in blocks], dtype=np.int64)
    ids = np.array([x for b in blocks for x in b], dtype=np.uint64)
    words, escapes, n_words, n_escapes = simple8b.pack(ids, ends)
    assert n_words.sum() == len(words) and n_escapes.sum() == len(escapes) == sum(x >= 2**60 for x in ids.tolist())
    first = np.repeat(np.cumsum(n_escapes) - n_escapes, n_words)
    assert simple8b.unpack(words, escapes, first).tolist() == ids.tolist()
    for i, b in enumerate(blocks):  # each block by itself
        w, e = slice(n_words[:i].sum(), n_words[: i + 1].sum()), slice(n_escapes[:i].sum(), n_escapes[: i + 1].sum())
        assert simple8b.unpack(words[w], escapes[e]).tolist() == b


def test_words_are_full():
    words = simple8b.pack(np.ones(600, np.uint64), np.array([600]))[0]
    assert len(words) == 10 and len(simple8b.pack(np.full(600, 32_767, np.uint64), np.array([600]))[0]) == 150
    with pytest.raises(ValueError):
        simple8b.unpack(np.array([15 << 60], np.uint64), np.zeros(0, np.uint64))


def expected(rows):
    whole = tokens.WordIds(tokens.tokenizer_path()).whole
    data = [(k, whole(t or "") + (2).to_bytes(4, "little")) for k, t in rows]
    data.sort(key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1]), len(r[1])))
    starts = np.cumsum([0, *(len(d) // 4 for _, d in data)]).tolist()
    return [(k, s, len(d) // 4, zlib.crc32(d), d) for (k, d), s in zip(data, starts)]


def written(spark, df, **options):
    folder = simple8b.id_folder(spark)
    files = simple8b.write(df, folder, **options)
    return files, sorted((tuple(r) for r in simple8b.read(files, folder, ids=True).collect()), key=lambda r: r[1])


def test_files_round_trip(spark, docs):
    for file_bytes in (simple8b.FILE_BYTES, 200_000):
        files, rows = written(spark, docs, file_bytes=file_bytes)
        assert [(*r[:4], bytes(r[4])) for r in rows] == expected(docs.select("doc_id", "text").collect())
        assert files.count() == 1 or files.count() > 3
    ids = sum(r[2] for r in rows)
    assert files.agg(F.sum("bytes")).first()[0] < 2.6 * ids


def test_files_edge_cases(spark):
    long = " ".join(f"word{i * i % 977}" for i in range(20_000))
    rows = [(5, "five"), (5, "cinq"), (5, "five"), (None, "no key"), (None, None), (-3, ""), (0, long), (9, "☃ 中文 <|endoftext|> \x1c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in CLASHES})
    _, got = written(spark, df, file_bytes=50)
    assert [(*r[:4], bytes(r[4])) for r in got] == expected(rows)
    files, got = written(spark, df.limit(0))
    assert files.count() == 0 and got == []


def test_rows_of_one_key_are_dealt_to_several_files(spark):
    rows = [(7 if i % 3 else None if i % 2 else i, f"text {i * i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    files, got = written(spark, df, file_bytes=1000)
    assert [(*r[:4], bytes(r[4])) for r in got] == expected(rows)
    assert files.count() > 8 and files.agg(F.max("docs")).first()[0] < 300


def test_broken_files_are_refused(spark, tmp_path):
    from pyarrow import fs

    out = simple8b.IdFile(str(tmp_path))
    words, _, n, e = simple8b.pack(np.arange(9, dtype=np.uint64), np.array([9]))
    out.add(1, 9, words.tobytes(), b"", np.array([n[0], e[0]], "<u4").tobytes())
    path = out.close()[0]
    data = open(path, "rb").read()
    for broken in (data[:-1], data[:20], b"", data[:16] + data[24:]):
        open(path, "wb").write(broken)
        with pytest.raises(ValueError):
            simple8b.IdFileReader(fs.LocalFileSystem(), path)


# --- 13: filter audit --------------------------------------------------------------------


def test_ranks_and_intervals():
    for n in (1, 3, 5):
        orders = list(itertools.permutations(range(n)))
        assert [filteraudit.lehmer_rank(o) for o in orders] == list(range(len(orders)))
        for mask in range(1 << n):
            step = {}
            for s, f, start, stop in filteraudit.intervals(mask, n):
                for r in range(start, stop):
                    assert r not in step
                    step[r] = (s, f)
            first = {r: next(((i + 1, f) for i, f in enumerate(o) if mask >> f & 1), None) for r, o in enumerate(orders)}
            assert step == {r: x for r, x in first.items() if x}


def run_filters(rows, names):
    """The audit by running every order over every row; a row is (part, failures, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = dict.fromkeys(names, 0)
        lines = {}
        for order in itertools.permutations(names):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                fails = sum(f in r[1] for r in own)
                lines["".join(order), step] = [len(left), len(gone), fails - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        out |= {(part, *k): (*v, total[k[0][k[1] - 1]]) for k, v in lines.items()}
    return out


def test_audit_of_flags(spark):
    rng = np.random.default_rng(4)
    rows = [(("p", "q", "r")[int(rng.integers(3)) // 2], {f for f in "XYZ" if rng.random() < 0.4}, bool(rng.random() < 0.5), bool(rng.random() < 0.2)) for _ in range(400)]
    df = spark.createDataFrame([(p, "X" in f, "Y" in f or None, "Z" in f, g, t) for p, f, g, t in rows], "part string, X boolean, Y boolean, Z boolean, good boolean, toxic boolean")
    got = filteraudit.audit(df, ["X", "Y", "Z"], "part", "good", "toxic").collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == run_filters(rows, "XYZ") and len(got) == 2 * 6 * 3
    with pytest.raises(ValueError):
        filteraudit.audit(df, ["X", "X"], "part", "good", "toxic")


def test_audit_of_documents(spark):
    words = " ".join(f"w{i}" for i in range(120))
    long = " ".join(f"w{i % 9000}" for i in range(20_000))
    texts = [(1, words, "en"), (2, words, "en"), (2, words, None), (2, words, "en"), (3, None, None), (4, "", ""), (None, words, "en"), (None, words, "en"), (5, long, "de"),
             (6, words.upper(), "de"), (7, words + " 100% & more", "de"), (8, "a\xa0b \x0b\x0c c", "de"), (9, "É" * 9 + "A", "fr"), (9, "É" * 8 + "A", "fr")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (7, None, 1), (5, 1, 0)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, lang string").withColumns({c: F.lit("x") for c in CLASHES})
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("good", F.lit("x"))
    rows = []
    for key, text, lang in texts:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, x in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)),
            key is not None and any(k is not None and k < key and (x or "") == t for k, x, _ in texts),
        )) if x}
        own = [m for m in labels if key is not None and m[0] == key]
        rows.append((lang or "", fails, any(m[1] == 1 for m in own), any(m[2] == 1 for m in own)))
    got = filteraudit.document_audit(df, marks).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == run_filters(rows, "ABCDE") and len(got) == 600 * len({r[0] for r in rows})
    assert filteraudit.document_audit(df.limit(0), marks).count() == 0


# --- 9: ids with several texts -----------------------------------------------------------


def test_ids_with_several_texts_lose_no_link(spark):
    rng = np.random.default_rng(11)
    base = [" ".join(f"g{g}w{i}" for i in range(60)) for g in range(30)]
    near = [b.replace("w30 ", "x30 ") for b in base]
    rows = [(g, base[g]) for g in range(30)] + [(100 + g, near[g]) for g in range(30)]
    rows += [(200 + int(i), base[g]) for g, i in enumerate(rng.integers(0, 12, 30))] + [(200 + int(i), near[(g + 7) % 30]) for g, i in enumerate(rng.integers(0, 12, 30))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, n=4).collect()}

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}

    sets = [(k, grams(t)) for k, t in rows]
    root = {k: k for k, _ in rows}
    for _ in range(len(root)):
        before = dict(root)
        for (a, x), (b, y) in itertools.combinations(sets, 2):
            if 100 * len(x & y) >= 80 * len(x | y):
                root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert got == root and len(set(root.values())) < 30


# --- 10: reading side by side --------------------------------------------------------------


def test_archives_are_read_side_by_side(spark):
    df = spark.range(4000).selectExpr("id AS page_id", "'http://a/' || id AS url", "repeat(md5(CAST(id AS STRING)), 20) AS html").repartition(8)
    folder = warc.archive_folder(spark)
    archives = warc.write(df, folder)
    assert archives.count() > 4
    tasks = warc.read(archives, folder).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(tasks) == archives.count() and sum(r["count"] for r in tasks) == 4000
