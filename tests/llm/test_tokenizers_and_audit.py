"""Operators 11 to 13 against plain versions and the libraries, and their defined results on odd rows."""

import hashlib
import random

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tribolens.llm import alignment, filter_audit, pieces, registry

A_PATH, B_PATH = registry.vocabulary("byte_bpe_50k.json"), registry.vocabulary("piece_bpe_32k.model")


def strange_texts(n, seed):
    rng = random.Random(seed)
    bits = ["the", "ing", " ", "  ", "    ", "\n", "\n ", "e", "<|endoftext|>", "<s>", "st'll", "　", "zz", "▁", "é", "日本", "\0", "\x85", "🙂"]

    def one():
        if rng.random() < 0.3:
            return "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x20, 0x3000), 32])) for _ in range(rng.randrange(60)))
        return "".join(rng.choice(bits) for _ in range(rng.randrange(50)))

    return [one() for _ in range(n)]


@pytest.fixture(scope="module")
def strange(spark, rows):
    found = rows + [(10_000 + i, t) for i, t in enumerate(strange_texts(600, 3))] + [(20_000, None)]
    return found, spark.createDataFrame(found, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def listed(binary):
    return np.frombuffer(binary, "<u4").tolist()


def test_pieces_equal_the_library(strange, library):
    found, docs = strange
    got = {r["doc_id"]: (listed(r["ids"]), r["decoded"]) for r in pieces.encode(docs, B_PATH, with_decoded=True).collect()}
    assert got == {i: ([1, *library.encode(t or ""), 2], library.decode([1, *library.encode(t or ""), 2])) for i, t in found}


def test_decoding_is_a_step_of_its_own(strange, library):
    found, docs = strange
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs, B_PATH), B_PATH).collect()}
    assert back == {i: library.decode(library.encode(t or "")) for i, t in found}


def test_pieces_of_one_long_word(library):
    rng = random.Random(1)
    for letters in ("ab", "e", "abcdefghij", " ", "日本"):
        text = "".join(rng.choice(letters) for _ in range(20_000))
        ids, _ = pieces.PieceEncoder(B_PATH).encode(pa.array([text, None, text]))
        one = [1, *library.encode(text), 2]
        assert ids.tolist() == [*one, 1, 2, *one]


def test_pieces_are_found_by_going_back():
    """Taking the longest piece each time is not enough: some texts need the way back, and plain merging agrees."""
    table, rng, greedy_fails = pieces.PieceTable(B_PATH), random.Random(2), 0
    for _ in range(3000):
        text = "".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 14)))
        found, place, greedy = table.cut(text), 0, []
        while place < len(text):
            size = next(k for k in range(len(text) - place, 0, -1) if k == 1 or text[place : place + k] in table.id_of)
            greedy.append(text[place : place + size])
            place += size
        greedy_fails += greedy != found
        assert found == table.merged(text)
    assert greedy_fails > 100


def test_memory_is_emptied(monkeypatch, library):
    monkeypatch.setattr(pieces, "CACHED_PARTS", 50)
    monkeypatch.setattr(pieces, "CACHED_PAIRS", 60)
    encoder = pieces.PieceEncoder(B_PATH)
    for texts in (strange_texts(40, s) for s in range(5)):
        ids, begin = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [[1, *library.encode(t), 2] for t in texts]
        assert len(encoder.table.fits) <= 60


def test_alignment_against_plain(strange):
    found, docs = strange
    want = plain.alignments(found, A_PATH, B_PATH)
    got = {r[0]: tuple(r)[1:] for r in alignment.link_statistics(docs, A_PATH, B_PATH).collect()}
    assert got == {i: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for i, w in want.items()}
    for r in alignment.aligned(docs, A_PATH, B_PATH).collect():
        assert ";".join("|".join(",".join(map(str, side)) for side in (g["a"], g["b"])) for g in r["groups"]) == want[r["doc_id"]][6]
        ends = [g["end"] for g in r["groups"]]
        assert ends == sorted(set(ends)) and (not ends or ends[-1] == len((" " + dict(found)[r["doc_id"]]).encode()))


def test_small_blocks_give_the_same_statistics(strange, monkeypatch):
    _, docs = strange
    want = sorted(alignment.link_statistics(docs, A_PATH, B_PATH).collect())
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 200)
    assert sorted(alignment.link_statistics(docs, A_PATH, B_PATH).collect()) == want


def plain_masks(rows):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    result = []
    for i, text, lang in rows:
        text = text or ""
        words = plain.SPACED.findall(text)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
                 any(c in "#$%&*|" for c in text), i is not None and i > least[text]]
        result.append((str(i), lang or "", sum(f << n for n, f in enumerate(fails))))
    return sorted(result)


@pytest.mark.parametrize("task_bytes", [filter_audit.TASK_BYTES, 100_000, 3000])
def test_masks_against_plain(spark, task_bytes):
    """Copies of one text beyond the size of a task, shared prefixes, nulls, one id with two texts."""
    rng = random.Random(5)
    base = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(40)]
    base += ["x" * 500, "x" * 500 + "y", "x" * 4, "x" * 16, "", "é#" * 30, "AB " * 300, " ".join(f"w{i}" for i in range(250))]
    rows = [(rng.randrange(900) if rng.random() > 0.02 else None, rng.choice(base) if rng.random() > 0.02 else None,
             rng.choice(["en", "de", None, ""])) for _ in range(1500)]
    rows += [(10_000 + i, "x" * 500, "en") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = filter_audit.failed_filters(docs, task_bytes).collect()
    assert sorted((str(r["doc_id"]), r["part"], r["mask"]) for r in got) == plain_masks(rows)
    if task_bytes == 3000:
        assert filter_audit.ranges(docs.select(F.coalesce("text", F.lit("")).alias("text")), task_bytes).shared


def test_trie_keeps_least_ids():
    rng, trie, least, ends = random.Random(3), filter_audit.TextTrie(), {}, []
    for i in rng.sample(range(3000), 1500):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(9))).encode()
        ends.append((text, trie.insert(text, i)))
        least[text] = min(least.get(text, i), i)
    assert all(node.least == least[text] for text, node in ends)
    nodes, open_ = 0, [trie.root]
    while open_:
        node = open_.pop()
        nodes += 1
        assert node is trie.root or node.least is not None or len(node.children) > 1
        open_ += node.children.values()
    assert nodes <= 2 * len(least) + 1


def test_steps_of_all_orders():
    """Counts of one mask over all orders: an order removes a document once, and Shapley sums count it 120 times."""
    for mask in range(1, 32):
        own = [s for s in filter_audit.steps() if s[0] == mask]
        assert len(own) == 600 and sum(s[5] for s in own) == 120
        assert sum(s[4] + s[5] + s[6] for s in own if s[2] == 1) == 120


def test_odd_rows_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(7004, 1, 0), (7004, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    odd = odd.withColumn("lang", F.lit(None).cast("string"))
    parts = odd.count()
    audit = filter_audit.audit(odd, labels).collect()
    assert len(audit) == 600 and {r["part"] for r in audit} == {""}
    assert all(r["kept"] + r["removed"] == parts for r in audit if r["step"] == 1)
    assert max(r["good_lost"] for r in audit) == max(r["toxic_lost"] for r in audit) == 1
    assert filter_audit.audit(empty.withColumn("lang", F.lit("en")), labels).count() == 0
    for found, n in ((odd, parts), (empty, 0)):
        assert alignment.link_statistics(found, A_PATH, B_PATH).count() == n
        assert alignment.aligned(found, A_PATH, B_PATH).count() == n
        assert pieces.encode(found, B_PATH).count() == n
    none = [r for r in alignment.link_statistics(odd, A_PATH, B_PATH).collect() if r["doc_id"] in (7000, 7001)]
    assert [tuple(r)[1:] for r in none] == [(0, 0, 0, 0, 0, 0, "")] * 2
