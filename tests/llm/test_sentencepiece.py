import numpy as np
import pytest

from loomgraph.llm.sentencepiece_codec import CharMap, Codec, model_path

CASES = ["", " ", "  a  b ", "Hello world.\nNew  line\ttab", "Éçeau für ñandú 你好 😀", "▁x▁ y", "a" * 900, "x\x00y", "é " * 20, "###$$$ the### a!!", "\n\n", "1 +1 (017) 555-7713", "un" * 700 + " z"]


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    return Codec(model_path()), sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.mark.parametrize("text", CASES)
def test_equals_the_library(both, text):
    own, lib = both
    ids, begins, ends = own.encode(text)
    assert ids == lib.encode(text)
    assert own.decode(ids) == lib.decode(ids)
    raw = text.encode()
    assert len(ids) == len(begins) == len(ends)
    if ids:
        assert b"".join(raw[b:e] for b, e in zip(begins, ends)) == raw
        assert np.all(begins[1:] == ends[:-1])


def test_equals_the_library_on_documents(both):
    import pyarrow.parquet as pq

    own, lib = both
    for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist():
        ids, _, _ = own.encode(t)
        assert ids == lib.encode(t)
        assert own.decode(ids) == lib.decode(ids)


def test_longest_prefix_of_a_character_map():
    m = CharMap(b"")
    m.rules, m.longest = {b"a": b"1", b"ab": b"22", "é".encode(): b"e"}, 2
    assert m.normalise("abaxé".encode()) == (b"221xe", [0, 0, 2, 3, 4], [2, 2, 3, 4, 6])


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_a_compiled_character_map_with_alignment(rule):
    import random

    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    m = pb.ModelProto()
    m.ParseFromString(lib.serialized_model_proto())
    own = CharMap(m.normalizer_spec.precompiled_charsmap)
    assert len(own.rules) > 1000
    r = random.Random(6)
    some = "ABCxyz \u00e9e\u0301\uff21\uff22\u2460\u3231\ufb01\u0130\u1e9e\u00bd\uac00\u1100\u1161\u0915\u093c\t\n\u3000\u4f60"
    for _ in range(300):
        text = "".join(r.choice(some) for _ in range(r.randint(0, 30)))
        out, begin, end = own.normalise(text.encode())
        assert out.decode() == lib.normalize(text), text
        assert len(begin) == len(end) == len(out) and all(a < b for a, b in zip(begin, end)) and begin == sorted(begin)


def test_query_of_nulls_repeats_and_empty_tables(spark, tmp_path, both):
    import hashlib

    from loomgraph.llm.sentencepiece_codec import op8_sentencepiece

    rows = [(1, None, 0), (2, "", 0), (3, "Some  words \u2581 here", 0), (3, "Some  words \u2581 here", 0), (4, "long " * 30_000, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens long").write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_sentencepiece(spark, str(tmp_path)).collect()
    lib = both[1]
    assert len(got) == 5
    for r in got:
        ids = lib.encode(dict((a, b) for a, b, _ in rows)[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert op8_sentencepiece(spark, str(tmp_path)).count() == 0
