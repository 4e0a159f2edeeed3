import hashlib
import random
import struct

import pytest

from colloquy.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def theirs():
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def test_encoder_matches_the_library(theirs):
    ours, rnd = bpe.WordBpe(open(bpe.default_vocabulary(), encoding="utf-8").read()), random.Random(1)
    letters = "abcXYZ  \t\n'’sStré9٣ΩσςΣİıßǺ\xa0\x85 \x1c\x1f​﻿漢字😀<|endoftext|>#$%_-\x00ﬁǅ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    for text in texts + ["a" * 5000, "ab" * 3000 + "Ω" * 300, "<|endoftext|>", "x<|startoftext|>World <|ENDOFTEXT|>"]:
        want = theirs.encode(text, add_special_tokens=False).ids
        packed, decoded = ours.encode(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == want
        assert decoded == theirs.decode(want, skip_special_tokens=False)


def test_every_code_point(theirs):
    """Letters, numbers, marks and unassigned code points are split as the library splits them, inside words and alone."""
    ours = bpe.WordBpe(open(bpe.default_vocabulary(), encoding="utf-8").read())
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"ab{c}c {c}9 ab{c}" for c in chars[k : k + 16]) for k in range(0, len(chars), 16)]
    for text, want in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        packed, _ = ours.encode(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == want.ids, text


def test_query(spark, corpus, rows, theirs):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op2_bpe(spark, f"{corpus}/full").collect()}
    want = set()
    for doc_id, text, *_ in rows:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        want.add((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    assert bpe.op2_bpe(spark, f"{corpus}/empty").count() == 0


def test_clashing_columns_and_decoding(spark):
    df = spark.createDataFrame([("keep", "Hello there", 1), (None, None, 2)], "ids string, text string, `n.tokens` int")
    got = bpe.bpe_encode(df.withColumnRenamed("ids", "_k1"), bpe.default_vocabulary())
    assert got.columns == ["_k1", "text", "n.tokens", "n_tokens", "ids", "decoded"]
    again = bpe.bpe_decode(got.select("ids", "decoded"), bpe.default_vocabulary(), to="again").collect()
    assert all(r.again == r.decoded for r in again)


def test_own_names_and_whole_decodings(spark, rows):
    """Columns of the operator's own names stay the caller's; one decoding of all ids is the glued one, repeats and all."""
    df = spark.createDataFrame([(d, t, 7, "mine", "k") for d, t, *_ in rows], "doc_id long, text string, N_tokens int, ids string, decoded string")
    got = bpe.bpe_encode(df, bpe.default_vocabulary())
    assert got.columns == [*df.columns, "n_tokens_", "ids_", "decoded_"]
    again = bpe.bpe_decode(got, bpe.default_vocabulary(), ids="ids_", to="again").collect()
    assert len(again) == len(rows) and all((r.N_tokens, r.ids, r.decoded) == (7, "mine", "k") and r.again == r.decoded_ and r.n_tokens_ == len(r.ids_) // 4 for r in again)


def test_character_tables_stay_small():
    """The pipeline's driver: asked block by block, the library takes little beside Python's own objects."""
    import subprocess
    import sys

    code = "import resource; from colloquy.llm import bpe; peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; was = peak(); bpe.character_tables(); print((peak() - was) // 1024)"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=str(__import__("pathlib").Path(bpe.__file__).parents[2])).stdout) < 160
