import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows_of

from gridloom.llm import quality as q
from gridloom.llm.words import pieces

CUE = "1\n00:00:01,000 --> 00:00:02,000\n"
SPEECH = [
    CUE + "Where is my strange letter?\nWe have to go.",
    CUE + "WHERE IS MY STRANGE LETTER?",
    CUE + "- Où est ton bateau ?\n- C'est le même marché, rien d'autre.",
    CUE + "MOKIL: Das ist nur deinen Brief.\n(laughing)\n[door creaks]",
    CUE + "♪ If you see the ladder, tell them they sold it ♪",
    CUE + "♪ Jemand hat diesen Mantel gesehen ♪",
    CUE + "いつ古い庭がないの？\n小さな鍵は川でもうなかった。",
    CUE + "Ð\x90 Ð¿Ð¾Ñ\x82Ð¾Ð¼ Ð¾Ð½ Ð¿Ñ\x80Ð¸Ñ\x88Ñ\x91Ð» Ð±ÐµÐ· Ñ\x81Ð»Ð¾Ð².",
    CUE + "å°\x8fã\x81\x95ã\x81ªé\x8dµã\x81¯å·\x9dã\x81§ã\x82\x82ã\x81\x86ã\x81ªã\x81\x8bã\x81£ã\x81\x9fã\x80\x82",
    CUE + "À ïîòîì îí ïðèø¸ë áåç ñëîâ.",
    CUE + "Givc me the key and get out of the Iadder.",
    CUE + '<i>Komm schon!</i>\n<font color="#ffff00">Bitte!</font>',
]
OTHER = [
    CUE + "Dialogue coach: Mozi Hamgri\nDrivers: Vanmozi Susu",
    CUE + "no | stop | heat 1 | out\n1 | Dax | 54.6 | 3778\n2 | Pe | 87.5 | 800",
    CUE + "9521f33352196cc571e96e8d48a3db52\n2dfc44861faf47b13a4c5af50b0d6252",
    CUE + "gcgnhphdxxt jfbxfdpdtr kvnhxgmnh",
    CUE + "&_*▓_+†▲@~◆▓@\n~^&░&¶*~●@÷",
    CUE + "m 526 510 l 433 801 120 618 b 691 303",
    CUE + "hahahahahahahaha\nhahahahahaha",
    CUE + "♪♪♪♪♪♪♪\n♪♪♪♪♪♪♪♪♪♪",
    CUE + "0 0 0 0 0 0\n0 0 0 0 0",
    CUE + "- boat\n• well\n- pêcheur",
    CUE + "Engine 3, 116-207\nMap 89, 117-172\nWait!",
    CUE + "frame=7 q=4.8 size=47210kB bitrate=1635.1k",
    CUE + "--------------\n-----------",
]
NOTHING = [None, "", " \n\t\r\n", "﻿", CUE, CUE + "[door creaks]\nSubtitles by the crew - www.crew.example", "WEBVTT\n\n12\n"]


def verdicts(texts):
    out = []
    for _, _, b, limits in pieces(pa.array(texts, pa.string())):
        s = q.batch_sums(b, limits)
        out += [None if r[8] + r[9] == 0 else bool(r[9] * 2 <= r[8] + r[9]) for r in s.tolist()]
    return out


@pytest.mark.parametrize(("texts", "want"), [(SPEECH, True), (OTHER, False), (NOTHING, None)])
def test_verdicts(texts, want):
    assert dict(zip(texts, verdicts(texts))) == dict.fromkeys(texts, want)


def test_line_ends_do_not_matter():
    for texts in (SPEECH, OTHER):
        for end in ("\r\n", "\r"):
            assert verdicts([t.replace("\n", end) for t in texts]) == verdicts(texts)


def sums(text, chunk=None, line=q.LINE):
    b = np.frombuffer(text.encode(), np.uint8)
    return (q.text_sums(b, chunk, line) if chunk else q.batch_sums(b, np.array([0, len(b)]), line)[0]).tolist()


def test_chunks_of_real_texts_agree(sf):
    for k, t in enumerate(pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column("text").to_pylist()):
        if t:
            assert sums(t, 600) == sums(t) and sums(t, 61 + k % 37) == sums(t)


SNIPPETS = [
    "the ", "boat", " you are it", "(a long sound description)", "[door", "]", "(", ")", "<i>", "</i>", "{an8}", "00:00:01,000 --> 00:00:02,000", "-->", "www.crew.example", "subtitles by x", "WEBVTT", "NOTE",
    "12", "7th", ". ", "! ", "?\"", "\n", "\r\n", "\r", "\n\n", "é", "ø¸", "Ð¿", "…", "。", "いつ", "鍵", "♪", "*", "│", "\ufeff", "\u3000", "🙂", "«oui»",
]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SNIPPETS), min_size=1, max_size=30), st.integers(2, 50), st.sampled_from([5, 16, 4096]))
def test_merged_partials_equal_the_whole(words, chunk, line):
    text = "".join(words)
    assert sums(text, chunk, line) == sums(text, None, line)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(SNIPPETS), min_size=4, max_size=30), st.integers(2, 20), st.integers(1, 5))
def test_merging_is_associative(words, chunk, at):
    parts = [q.Partial.of(*x) for x in q.cut(np.frombuffer("".join(words).encode(), np.uint8), chunk)]
    whole = q.finish(q.merge(parts)).tolist()
    assert q.finish(q.merge([q.merge(parts[:at]), *([q.merge(parts[at:])] if parts[at:] else [])])).tolist() == whole


def test_one_line_of_many_chunks():
    text = "the boat is old " * 5000
    assert sums(text, 1001) == sums(text) and sums(text)[0] == -(-len(text) // q.LINE)


def test_batches_equal_single_texts():
    texts = [t for t in SPEECH + OTHER + NOTHING if t]
    raw = [t.encode() for t in texts]
    limits = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    together = q.batch_sums(np.frombuffer(b"".join(raw), np.uint8), limits).tolist()
    assert together == [sums(t) for t in texts]


def test_table(spark):
    texts = [*SPEECH, *OTHER, *NOTHING, SPEECH[0] + "\n" + "We have to go. " * 200_000]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(0, texts[0], 1)], "doc_id bigint, text string, n_words int")
    rows = q.quality(df).collect()
    assert len(rows) == len(texts) + 1
    by = {r["doc_id"]: r for r in rows}
    assert sorted(r[0] for r in q.not_speech(df).collect()) == list(range(len(SPEECH), len(SPEECH) + len(OTHER)))
    first = by[0]
    assert (first["n_words"], first["speech_lines"], first["end_punctuation_share"]) == (9, 2, 1.0)
    assert abs(first["mean_word_length"] - 32 / 9) < 1e-9
    huge = by[len(texts) - 1]
    assert huge["n_words"] == 9 + 4 * 200_000 and huge["n_chars"] == len(texts[-1].replace("\n", "")) and huge["is_speech"]
    for chunk in (50, 1000):
        few = df.where("doc_id < 30")
        assert rows_of(q.quality(few, chunk=chunk)) == rows_of(q.quality(few))
    nothing = by[len(SPEECH) + len(OTHER)]
    assert nothing["n_chars"] == 0 and nothing["is_speech"] is None and nothing["mean_word_length"] is None
    assert q.quality(df.limit(0)).collect() == []
