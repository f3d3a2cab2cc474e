"""Byte-level BPE with a local rank file: encoding and decoding."""
from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from opslake.llm.rows import per_text

#: Texts longer than this are encoded in pieces.
LONG_CHARS = 50_000
#: Runs of white space longer than this are encoded as pieces of their own: the splitting pattern backtracks in them.
LONG_BLANK = 1_000
# The characters with the property White_Space.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RUN = re.compile(f"[{_SPACE}]{{{LONG_BLANK},}}")
_CUT = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")


@functools.lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, long_chars: int = LONG_CHARS) -> Iterator[str]:
    """Cut a text where a character other than white space is followed by white space.

    There a match of the pattern always ends and another begins, whatever stands further away: no alternative goes on
    from another character into white space, and none looks back.
    """
    start = 0
    while len(text) - start > long_chars:
        cut = _CUT.search(text, start + long_chars)
        if not cut:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(encoding, text: str) -> list[int]:
    """Ids of a text, equal to encoding it at once, for texts of any length and runs of any length."""
    if len(text) <= LONG_BLANK:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    start = 0
    for run in _RUN.finditer(text):
        # A run ends its match one character early if something follows, as that character may belong to the next match.
        end = run.end() if run.end() == len(text) else run.end() - 1
        for piece in safe_pieces(text[start:run.start()]):
            ids += encoding.encode_ordinary(piece)
        ids += encoding._encode_single_piece(text[run.start():end])
        start = end
    for piece in safe_pieces(text[start:]):
        ids += encoding.encode_ordinary(piece)
    return ids


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of each whole text, without special tokens, by the rank file at ``ranks``.

    Each match of ``pattern`` is merged separately. Null or empty text gives an empty list. Other columns pass through,
    a column named ``ids`` is replaced, rows stay as many as they are. The rank file must lie at the same path on every
    machine; its vocabulary is read once per Python worker.
    """
    def make():
        encoding = _encoding(ranks, pattern)
        return lambda texts: [[encode_text(encoding, t) for t in texts]]

    return per_text(docs, text, {ids: "array<int>"}, make)


def decode(tokens: DataFrame, ranks: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the raw bytes of each list of ids; null gives empty bytes. Bytes need not be whole UTF-8 characters."""
    import pyarrow as pa
    from pyspark.sql import types as T

    tokens = tokens.drop(decoded)
    schema = T.StructType([*tokens.schema.fields, T.StructField(decoded, T.BinaryType())])

    def run(batches):
        encoding = _encoding(ranks, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                lists = part.column(part.schema.get_field_index(ids))
                out = [encoding.decode_bytes(x.values.to_pylist() if x.is_valid else []) for x in lists]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=schema.names)

    return tokens.mapInArrow(run, schema)
