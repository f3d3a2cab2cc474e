"""Token counts with whole-token shortcuts."""
from __future__ import annotations

import functools
import os
import re

from pyspark.sql import DataFrame, functions as F

from opslake.llm.rows import per_text, text_of

#: Pre-tokens whose count a worker remembers; the memory starts anew when full, which costs time only.
REMEMBERED = 300_000
# The pattern of the byte-level pre-tokenizer, a fixed value.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters that this pattern's library and the tokenizer's class alike; a text with others goes to the tokenizer whole.
_ALIKE = re.compile("[\\0-\\u0530\\u2010-\\u2064\\u20a0-\\u20bf\\u3000-\\u30ff\\u4e00-\\u9fff\\uac00-\\ud7a3]*")


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def single_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings proven to be one pre-token that encodes alone as one token.

    Each string of the vocabulary is decoded, encoded by the tokenizer itself and kept if one id, its own, comes back.
    """
    import regex

    tok = _tokenizer(path)
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    ids = sorted(tok.get_vocab().values())
    texts = tok.decode_batch([[i] for i in ids], skip_special_tokens=False)
    whole = regex.compile(_PATTERN)
    keep = [(i, t) for i, t in zip(ids, texts, strict=True) if t and "\ufffd" not in t and t not in special and whole.fullmatch(t)]
    codes = tok.encode_batch([t for _, t in keep], add_special_tokens=False)
    return frozenset(t for (i, t), e in zip(keep, codes, strict=True) if e.ids == [i])


class Counter:
    """Counts tokens as the tokenizer of a byte-level ``.json`` file does, without encoding known pre-tokens."""

    def __init__(self, path: str):
        import regex

        self.tok = _tokenizer(path)
        self.whole = dict.fromkeys(single_tokens(path), 1)
        self.known = dict(self.whole)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.findall = regex.compile(_PATTERN).findall

    def __call__(self, text: str) -> int:
        if not _ALIKE.fullmatch(text) or any(s in text for s in self.special):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        parts = self.findall(text)
        known = self.known
        missing = {p for p in parts if p not in known}
        if missing:
            if len(known) + len(missing) > REMEMBERED + len(self.whole):
                known = self.known = dict(self.whole)
                missing = {p for p in parts if p not in known}
            missing = list(missing)
            known.update(zip(missing, (len(e.ids) for e in self.tok.encode_batch_fast(missing, add_special_tokens=False)), strict=True))
        return sum(map(known.__getitem__, parts))


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for each whole text.

    Counts equal those of the tokenizer file at ``path`` without begin, end or padding; special strings inside a text
    are handled as the tokenizer does by default. Null or empty text has no bytes and no tokens. Columns of those three
    names are replaced, others pass through; each row is counted for itself, so repeated rows and ids do not matter.
    Pre-tokens that are proven single tokens are counted by a look-up, only the rest is merged.
    """
    counted = per_text(docs, text, {"n_tokens": "bigint"}, lambda: _make(path))
    return counted.drop("n_bytes", "over_limit").select(
        "*", F.octet_length(text_of(text)).cast("long").alias("n_bytes"), (F.col("n_tokens") > limit).alias("over_limit"))


def _make(path: str):
    count = Counter(path)
    return lambda texts: [[count(t) for t in texts]]
