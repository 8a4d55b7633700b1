"""Files of token ids: exact round trips of planes, files, and the query against the tokenizer itself."""

from __future__ import annotations

import io
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cases import ROWS, SMALL, clashing, documents, rows_of
from mercato.llm import id_files, queries
from mercato.session import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
whole_ids = st.lists(st.integers(0, 2**32 - 1), max_size=70).map(lambda v: np.array(v, "<u4"))


@given(whole_ids, st.sampled_from([id_files.BYTE, id_files.BIT]))
@settings(max_examples=200, deadline=None)
def test_planes_come_back(ids, planes):
    assert (id_files.from_planes(id_files.to_planes(ids, planes), len(ids), planes) == ids).all()


@given(st.lists(st.tuples(st.none() | st.integers(-5, 5), whole_ids), max_size=9), st.integers(1, 40), st.data())
@settings(max_examples=100, deadline=None)
def test_files_come_back(docs, block, data):
    planes = data.draw(st.sampled_from([id_files.BYTE, id_files.BIT]))
    out = id_files.IdWriter(planes, block)
    for doc_id, ids in docs:
        out.add(doc_id, ids)
    file = id_files.IdFile(io.BytesIO(out.close()))
    every = np.concatenate([ids for _, ids in docs] or [np.empty(0, "<u4")])
    start, stop = sorted(data.draw(st.tuples(st.integers(0, 99), st.integers(0, 99))))
    assert (file.ids(start, stop) == every[start:stop]).all()
    found = [(r, np.frombuffer(ids, "<u4").tolist()) for f in id_files._documents("x", file, 7)
             for r, ids in zip(f[["doc_id", "none"]].itertuples(index=False, name=None), f["ids"])]
    assert found == [((d or 0, d is None), ids.tolist()) for d, ids in docs]


def test_damage_is_seen():
    out = id_files.IdWriter()
    out.add(1, np.arange(5000, dtype="<u4"))
    content = out.close()
    with pytest.raises(ValueError):
        id_files.IdFile(io.BytesIO(content[:-1]))
    with pytest.raises(Exception):
        id_files.IdFile(io.BytesIO(b"\0" * 100 + content[100:])).ids(0, 10)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("stretch", [60, 1 << 20])
def test_pieces_give_the_ids_of_the_text(monkeypatch, name, stretch):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    odd = "don't 12 3.4  two  blanks \n\n line\t tab Äpfel größer 漢字 wörter... it's we'll\r\n x" * 40
    texts = [odd, odd.encode('ascii', 'ignore').decode(), "", "a" * 500, " " * 300, odd[7:], "a <|endoftext|> b", "'s'S 'LL\x1c\x85\xa0\u3000x\u200by \ufeff"]
    monkeypatch.setattr(id_files, "STRETCH", stretch)
    monkeypatch.setattr(id_files, "REMEMBERED", 3)
    found = [ids.tolist() for ids in id_files.Encoder(path).encode(texts)]
    assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=300, deadline=None)
def test_any_text(texts):
    found = [ids.tolist() for ids in id_files._encoder(PATH).encode(texts)]
    assert found == [e.ids for e in _library().encode_batch(texts, add_special_tokens=False)]


@cache
def _library():
    return Tokenizer.from_file(PATH)


@given(st.lists(st.sampled_from(["a", "don't", "'s", "é", "中文", "7,", "", "\n", "\t", "\xa0", "\x1c", "\u3000", "."]), max_size=8))
@settings(max_examples=300, deadline=None)
def test_white_space_beside_blanks(words):
    encoder, text = id_files._encoder(PATH), " ".join(words)
    want = encoder.library.encode(text, add_special_tokens=False).ids
    assert [ids.tolist() for ids in encoder.encode([text, text])] == [want, want]


def test_a_word_that_comes_again_is_cut_once(monkeypatch):
    encoder, cut = id_files.Encoder(PATH), []
    pattern = id_files.ASCII_PIECE

    class Counting:
        def findall(self, text):
            cut.append(text)
            return pattern.findall(text)

    monkeypatch.setattr(id_files, "ASCII_PIECE", Counting())
    first, *again = encoder.encode(["A word, once"] + ["A word, A word, once once"] * 3)
    assert [cut.count(word) for word in (" word,", " once")] == [2, 2]
    assert again[0].tolist() == encoder.library.encode("A word, A word, once once", add_special_tokens=False).ids
    assert len(first) and all((ids == again[0]).all() for ids in again)
    assert max(map(len, cut)) < len("A word, A word")


@pytest.mark.parametrize("letter", ["a", "ä"])
def test_a_word_that_many_texts_share_is_cut_once(monkeypatch, letter):
    encoder, cut = id_files.Encoder(PATH), []

    class Counting:
        def __init__(self, pattern):
            self.pattern = pattern

        def findall(self, text):
            cut.append(text)
            return self.pattern.findall(text)

    for name in ("ASCII_PIECE", "PIECE"):
        monkeypatch.setattr(id_files, name, Counting(getattr(id_files, name)))
    words = [f"{letter}{n}," for n in range(3000)]
    texts = [" ".join(["Start", *words[k:], *words[:k]]) for k in (0, 7, 70, 700)]
    found = [ids.tolist() for ids in encoder.encode(texts)]
    assert sum(text.count(f" {letter}") for text in cut) == len(words)
    assert found == [e.ids for e in _library().encode_batch(texts, add_special_tokens=False)]


odd_texts = st.lists(
    st.sampled_from(["a", "don't", "'s", "é", "Ünï,", "中文", "7,", "", "\n", "b\n", "\nc", "\xa0", "\x1c", "\u3000", ".", "<|endoftext|>"])
    | st.text(max_size=5),
    max_size=8,
).map(" ".join)


@given(st.lists(odd_texts, max_size=9), st.integers(1, 60), st.sampled_from([3, 10, 10**6]))
@settings(max_examples=400, deadline=None)
def test_texts_looked_up_together(texts, group, remembered):
    with pytest.MonkeyPatch.context() as patch:
        for name, value in (("GROUP", group), ("LEAST", 0), ("STRETCH", 20), ("REMEMBERED", remembered)):
            patch.setattr(id_files, name, value)
        found = [ids.tolist() for ids in id_files._encoder(PATH).encode(texts)]
    assert found == [e.ids for e in _library().encode_batch(texts, add_special_tokens=False)]


def test_every_character_is_cut_alike():
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    around = lambda c: f"a{c}1{c}!{c} {c}\n{c}{c}'{c} "
    texts = ["".join(around(chr(c)) for c in codes[k : k + 128]) for k in range(0, len(codes), 128)]
    found = id_files.Encoder(PATH).encode(texts)
    wrong = []
    for k, (ids, e) in enumerate(zip(found, _library().encode_batch_fast(texts, add_special_tokens=False))):
        if ids.tolist() != e.ids:
            wrong.append(k)
    assert not wrong


def brute(rows):
    encoder, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in rows:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_tokenizer(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    expected = brute(sorted(map(tuple, rows)))
    assert rows_of(queries.op12_token_ids(spark, SMALL)) == sorted(expected, key=repr)


@pytest.mark.parametrize("planes", [id_files.BYTE, id_files.BIT])
def test_awkward_rows_and_small_files(spark, planes):
    docs, folder = clashing(documents(spark)).repartition(3), fresh_path(spark, "ids")
    index = id_files.write_ids(docs, folder, PATH, planes, block=100, file_ids=50)
    assert index.count() > 5 and index.agg(F.sum("n_docs")).first()[0] == len(ROWS)
    found = id_files.read_ids(spark, folder, index).collect()
    encoder = Tokenizer.from_file(PATH)
    ids = {text: [*encoder.encode(text or "", add_special_tokens=False).ids, 0] for _, text, *_ in ROWS}
    assert sorted(repr((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist())) for r in found) == sorted(
        repr((r[0], ids[r[1]])) for r in ROWS
    )
    ordered = sorted(found, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [0, *np.cumsum([r["n_tokens"] for r in ordered])[:-1]]
    assert [r["doc_id"] for r in ordered] == sorted((r[0] for r in ROWS), key=lambda d: (d is not None, d or 0))


def test_files_of_failed_attempts_are_not_read(spark):
    docs, folder = documents(spark), fresh_path(spark, "ids")
    index = id_files.write_ids(docs, folder, PATH)
    before = rows_of(id_files.read_ids(spark, folder, index))
    id_files.write_ids(docs.limit(3), folder, PATH)
    assert rows_of(id_files.read_ids(spark, folder, index)) == before


def test_empty_table(spark):
    folder = fresh_path(spark, "ids")
    index = id_files.write_ids(documents(spark, []), folder, PATH)
    assert index.count() == 0 and id_files.read_ids(spark, folder, index).count() == 0
