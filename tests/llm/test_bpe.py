import hashlib
import json

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegauge.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
REF = Tokenizer.from_file(PATH)
OWN = bpe.Bpe(bpe.read_spec(PATH))
CACHED = bpe.Cached(OWN, most=5)
TEXTS = ["", "Hello\x1cworld a\x1db", "it's don'T ΑΣ ΣΑΣ İx ǅ", "<|endoftext|>Hi <|ENDOFTEXT|> x<|startoftext|>y", "ab12 ½ ٣ ", "é Å a<|endoftext|>́b", "x" * 5000, "日本語 ​ c\x85d\xa0e !!'s", "null\x00byte", "\x1c", "\U0001f600🏽 ok"]


def ref(text):
    ids = REF.encode(text, add_special_tokens=False).ids
    return ids, REF.decode(ids, skip_special_tokens=False)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def agree(text):
    ids, decoded = ref(text)
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == decoded
    assert CACHED.digest(text) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


def test_known_texts():
    for t in TEXTS:
        agree(t)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    agree(text)


def test_every_code_point():
    """Letters, numbers, white space, case and marks are the library's for all of Unicode."""
    for first in range(0, 0x110000, 4096):
        chars = [chr(c) for c in range(first, first + 4096) if not 0xD800 <= c < 0xE000]
        if not chars:
            continue
        text = "\n".join(f"a{c}b. {c}'s 1{c}2 é{c}\u0301" for c in chars)
        if OWN.encode(text) != ref(text)[0]:
            for c in chars:
                agree(f"a{c}b. {c}'s 1{c}2 é{c}\u0301")
    for text in ("a\U0001f600b é\U0001f3fd", "Ａ\U00010d50\u0301 Σ\U0001e4ec\u0315", "x\U0002ebf0y \U0010ffff"):
        agree(text)


def test_a_word_may_be_cached_in_one_way_only():
    """A run that is no letter run is cut the same way whichever path meets it first."""
    for texts in (["it's \U0001fae8 it's", "it's"], ["it's", "it's \U0001fae8 it's"], ["a1 \U0001fae8", "a1"]):
        own = bpe.Cached(OWN)
        for t in texts:
            ids, decoded = ref(t)
            assert own.digest(t) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


@pytest.mark.parametrize("change", [{"decoder": {"type": "ByteLevel"}}, {"normalizer": None}, {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFKC"}]}}, {"pre_tokenizer": {"type": "Whitespace"}}])
def test_other_tokenizers_are_refused(change):
    spec = json.loads(bpe.read_spec(PATH))
    with pytest.raises(ValueError):
        bpe.Bpe(json.dumps({**spec, **change}))
    with pytest.raises(ValueError):
        bpe.Bpe(bpe.read_spec(public_tokenizers.path("byte_bpe_50k.json")))


def test_another_pattern():
    spec = json.loads(bpe.read_spec(PATH))
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\p{L}+|[^\s\p{L}]+"
    own, lib = bpe.Bpe(json.dumps(spec)), Tokenizer.from_str(json.dumps(spec))
    for t in [*TEXTS, "a.b,c 12,5. x'y"]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and bpe.Cached(own).digest(t)[:2] == (len(ids), sha(" ".join(map(str, ids))))


def test_frames(spark):
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(98, None, None), (0, "", "k"), (None, "a b", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sorted(map(tuple, bpe.round_trip(docs).collect()), key=repr)
    expect = []
    for i, t, _ in rows:
        ids, decoded = ref(t or "")
        expect.append((i, len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    assert out == sorted(expect, key=repr)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs.filter("doc_id is not null"))).collect()}
    assert back[98] == "" and back[4] == ref(TEXTS[4])[1]
    assert bpe.round_trip(docs.limit(0)).count() == 0
