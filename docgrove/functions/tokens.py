"""An exact cap on the tokens of a text, by a given vocabulary file."""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_CAP = 8100
# Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: The vocabulary that counts tokens where no other is named.
VOCABULARY = os.path.join(os.environ.get("DOCGROVE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("cap", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


@dataclass(frozen=True)
class TokenCap:
    """Cuts texts to `cap` tokens; `ranks` is the content of a file of (base64 token, rank) lines."""

    ranks: bytes
    pattern: str = PATTERN
    cap: int = TOKEN_CAP

    @classmethod
    def from_file(cls, path: str, **settings) -> TokenCap:
        with open(path, "rb") as f:
            return cls(f.read(), **settings)

    @classmethod
    def default(cls) -> TokenCap:
        """TOKEN_CAP tokens of VOCABULARY; an error where that file is missing, for no other count is exact."""
        if not os.path.exists(VOCABULARY):
            raise FileNotFoundError(f"embedding inputs are cut by tokens: name a vocabulary file, there is none at {VOCABULARY}")
        return cls.from_file(VOCABULARY)

    def cut(self, text: str) -> str:
        ids = _encoding(self.ranks, self.pattern).encode_ordinary(text)
        return text if len(ids) <= self.cap else _encoding(self.ranks, self.pattern).decode(ids[: self.cap])

    def cut_batch(self, texts: pa.Array) -> pa.Array:
        """``cut`` of every text of a batch.  A token has a byte at least, so texts of no more bytes than the cap stay."""
        long = pc.fill_null(pc.greater(pc.binary_length(texts), self.cap), False)
        found = texts.filter(long)
        return pc.replace_with_mask(texts, long, pa.array((self.cut(t.as_py()) for t in found), texts.type, size=len(found))) if len(found) else texts

    def apply(self, text: Column) -> Column:
        """The capped text.  A token has a byte at least, so only texts of more bytes than the cap reach Python."""

        @F.pandas_udf("string")
        def cut(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else self.cut(t))

        return F.coalesce(cut(F.when(F.octet_length(text) > self.cap, text)), text)
