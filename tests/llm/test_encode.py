import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import encode as e
from gridloom.llm import words as w

pytestmark = pytest.mark.skipif(not os.path.exists(w.VOCABULARY), reason="no vocabulary files here")
VOCABULARY = w.Vocabulary.read(w.VOCABULARY) if os.path.exists(w.VOCABULARY) else None
ODD = [
    None, "", " ", "\n\n", "a", "'", "it's 5's don'T we'll", "<|endoftext|> is text", "00:01:02,176 --> 00:01:03,893\r\n- Où est ton bateau ?\r\n", "﻿WEBVTT\n\n",
    "Он видел наш дом. 　  x", "いつ古い庭がないの？\n小さな鍵は川でもうなかった。", "Ð¢Ñ\x83 Â\x85 x", "  two  spaces   end  ", "tab\t\tx\x0b\x0cy\x1c\x1dz", "1234567890" * 40, "é \U0001f600 \U0001f600x 5", "''''s '''ll x''d",
]


def ids_of(texts, encoder=None, most=w.PIECE):
    encoder = encoder or w.WordEncoder(VOCABULARY)
    out = []
    for _, _, b, limits in w.pieces(pa.array(texts, pa.string()), most):
        ids, n = encoder.texts(b, limits)
        at = np.concatenate([[0], np.cumsum(n)])
        out += [ids[at[k] : at[k + 1]].tolist() for k in range(len(n))]
    return out


def whole(text):
    return w._tokenizer(VOCABULARY).encode_ordinary(text or "")


def test_odd_texts():
    assert ids_of(ODD) == [whole(t) for t in ODD]


def test_real_texts_agree_also_with_a_tiny_cache(sf):
    texts = pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column("text").to_pylist()
    want = [whole(t) for t in texts]
    assert ids_of(texts) == want
    small = w.WordEncoder(VOCABULARY, slots=64)
    assert ids_of(texts, small, 3000) == want
    assert ids_of(texts, small, 3000) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab's 19.,-\n\t 　éя。ー 'TD")), max_size=60), max_size=5))
def test_any_text(texts):
    assert ids_of(texts) == [whole(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab's 19.,\n é。")), min_size=2, max_size=50), st.data())
def test_every_seam_is_one(text, data):
    b = np.frombuffer(text.encode(), np.uint8)
    for i in np.flatnonzero(w.seams(b)):
        left, right = b[:i].tobytes().decode(), b[i:].tobytes().decode()
        assert whole(left) + whole(right) == whole(text)


def by_chunks(texts, starts):
    """ids of texts put together from parts, parts beginning at the given positions."""
    enc, ids, chunk, document = w._tokenizer(VOCABULARY).encode_ordinary, [], [], []
    for text, cuts in zip(texts, starts, strict=True):
        parts = [enc(text[i:j]) for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        ids += [x for p in parts for x in p]
        chunk += [len(p) for p in parts]
        document.append(len(parts))
    out, n, told = e.assemble(np.array(ids, np.int64), np.array(chunk), np.array(document), w.WordEncoder(VOCABULARY), VOCABULARY)
    at = np.concatenate([[0], np.cumsum(n)])
    return [out[at[k] : at[k + 1]].tolist() for k in range(len(n))], told


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=st.sampled_from(list("ab's 19.,-\n\t 　éя。ー 'TD🙂")), max_size=60), st.sets(st.integers(1, 59), max_size=6)), min_size=1, max_size=5))
def test_joins_anywhere_are_repaired(made):
    texts = [t for t, _ in made]
    starts = [sorted(c for c in cuts if c < len(t)) for t, cuts in made]
    assert by_chunks(texts, starts)[0] == [whole(t) for t in texts]


def test_joins_within_words_need_repair():
    text = "We have to go to the harbour tomorrow."
    got, (joins, bad, again) = by_chunks([text], [[23]])
    assert got == [whole(text)] and (joins, bad) == (1, 1) and 0 < again < len(text) and whole(text[:23]) + whole(text[23:]) != whole(text)


def test_chunks_depend_on_nearby_content_only():
    rng = random.Random(3)
    passage = "".join(rng.choice(["the ", "boat ", "17 ", "where", ", ", "é", "いつ"]) for _ in range(900))
    starts = []
    for front in ("", "Something else first. ", "x" * 37 + " "):
        b = np.frombuffer((front + passage).encode(), np.uint8)
        s = e.chunk_starts(b, np.zeros(1, np.int64)) - len(front)
        starts.append(set(s[s > e.WINDOW].tolist()))
    assert starts[0] == starts[1] == starts[2] and len(starts[0]) > 3


def test_chunks_have_the_length_asked_for(sf):
    texts = [t for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column("text").to_pylist() if t]
    b = np.frombuffer("".join(texts).encode(), np.uint8)
    n = len(e.chunk_starts(b, np.zeros(1, np.int64)))
    assert 0.6 * e.AVERAGE < len(b) / n < 1.6 * e.AVERAGE


def test_table(spark):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(ODD)] + [(0, None, 1), (None, "x", 1)], "doc_id bigint, text string, ids int")
    got = [(r["doc_id"], list(r["ids"])) for r in e.encoded(df).collect()]
    assert sorted(got, key=repr) == sorted([(k, whole(t)) for k, t in enumerate(ODD)] + [(0, []), (None, whole("x"))], key=repr)
    counts = [(r["doc_id"], r["n_tokens"]) for r in w.token_counts(df).collect()]
    assert sorted(counts, key=repr) == sorted([(k, len(i)) for k, i in got], key=repr)
    few = [(r["doc_id"], list(r["ids"])) for r in e.encoded(df.repartition(3), average=20).collect()]
    assert sorted(few, key=repr) == sorted(got, key=repr)
    assert e.encoded(df.limit(0)).collect() == []


def test_many_copies(spark):
    """A text of a third of all rows: its chunks are sent once per piece of input, and every copy comes out."""
    text = "Where is my strange letter? We have to go. " * 40
    df = spark.createDataFrame([(k, text if k % 3 == 0 else f"{k} {text[:k]}") for k in range(600)], "doc_id bigint, text string").repartition(2)
    sent = e.chunks(df).selectExpr("max(size(rows)) AS most", "sum(size(rows)) AS places").first()
    assert sent["most"] >= 50
    got = {r["doc_id"]: list(r["ids"]) for r in e.encoded(df).collect()}
    assert got == {k: whole(text if k % 3 == 0 else f"{k} {text[:k]}") for k in range(600)}
    report = e.reuse_report(df).first()
    assert report["chunks"] == sent["places"] and report["reused_share"] > 0.3
