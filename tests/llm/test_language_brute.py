"""Operator 9 against a plain version of its definition, and the encoder's choice of whole texts."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from cases import ROOT
from test_maps import TOKENIZER

from inkwell.llm import language, tokens
from inkwell.llm.queries import QUERIES

LETTERS = dict(window_log=18, chain_log=17, hash_log=17, search_log=3, min_match=4, strategy=zstandard.STRATEGY_LAZY)


def samples(rows):
    """Each language's sample: the lowest hash of each of 448 slots, a passage of 2048 characters each, in hash order."""
    slots, count = {}, {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 or r.lang is None or not any(c.isalpha() for c in r.text or ""):
            continue
        h = xxhash.xxh64_intdigest(r.text.encode(), seed=42)
        signed = h - (1 << 64) if h >> 63 else h
        count[r.lang] = count.get(r.lang, 0) + 1
        key = (r.lang, signed % 448)
        if key not in slots or signed < slots[key][0]:
            slots[key] = (signed, r.text[(h >> 20) % max(len(r.text) - 2047, 1) :][:2048].lower())
    out = {}
    for lang in sorted(count, key=lambda x: (-count[x], x)):
        sample = b""
        for _, text in sorted(v for k, v in slots.items() if k[0] == lang):
            sample += text.encode()[:2048].decode(errors="ignore").encode() + b"\n"
            if len(sample) >= 112 * 1024:
                break
        out[lang] = sample[: 112 * 1024]
    return out


def smallest(text, sample_of):
    """The language whose dictionary makes the text smallest, and the margin over the second."""
    if text is None or not any(map(str.isalpha, text)):
        return "und", 0.0
    raw, costs = text.lower().encode(), []
    for sample in sample_of.values():
        cut = 1024 if len(sample) > 2048 else len(sample) - len(sample) // 2
        lead, rest = sample[len(sample) - cut :], sample[: len(sample) - cut]
        params = zstandard.ZstdCompressionParameters(write_checksum=False, write_content_size=False, write_dict_id=False, **LETTERS)
        size = lambda x, d=zstandard.ZstdCompressionDict(rest.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT), p=params: len(zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress(x))
        if len(raw) < 512:
            costs.append(size(lead + raw) - size(lead))
        else:
            costs.append(sum(size(raw[i : i + 2048]) for i in range(0, len(raw), 2048)))
    best, second = sorted(costs)[:2]
    return list(sample_of)[costs.index(best)], (second - best) / second


def test_query_equals_the_plain_version(spark):
    rows = spark.read.parquet(f"{ROOT}/documents.parquet").collect()
    sample_of = samples(rows)
    got = {r.doc_id: r for r in QUERIES["op9_language_id"](spark, ROOT).collect()}
    assert len(got) == len(rows) and len(sample_of) > 1
    for r in rows:
        lang, margin = smallest(r.text, sample_of)
        found = got[r.doc_id]
        assert found.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert (found.lang_pred, found.rejected) == (lang, lang == "und" or margin < 0.004), r.doc_id
        assert found.score == pytest.approx(min(1.0, margin / 0.04))


def test_too_many_languages_are_refused(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 8 languages"):
        language.train(docs, most=8)
    assert len(language.train(docs, most=9)) == 9


def test_tokenizers_that_keep_white_space_get_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    keeps = Tokenizer.from_file(TOKENIZER.replace("word_bpe_49k", "byte_bpe_50k"))
    path = str(tmp_path / "keeps.json")
    keeps.save(path)
    encoder = tokens.Encoder(path, 2)
    assert encoder.whole and not tokens.Encoder(TOKENIZER, 2).whole
    texts = ["two  words\n", " lead", "", None, "a\tb"]
    want = [e.ids + [2] for e in keeps.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(b, encoder.width).tolist() for b in encoder.documents(pa.array(texts))] == want
    drops = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1}, unk_token="[UNK]"))
    drops.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    drops.save(path)
    assert not tokens.Encoder(path, 2).whole
