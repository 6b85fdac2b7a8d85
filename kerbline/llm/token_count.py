"""Token counts with a whole-token shortcut for a sentencepiece BPE model.

A text is cut where no merge can ever reach: before a space that follows another character, and around a
character that no longer piece contains.  ``Shortcut`` proves both on the vocabulary, and proves which pieces
encode alone as one token.  Pre-tokens among those count 1 without a merge; the rest are merged once and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SPACE = "▁"
# Merged pre-tokens remembered per worker, and the longest that is worth remembering.
MEMO_SIZE, MEMO_CHARS = 300_000, 48


class Shortcut(dict):
    """Pre-token -> number of tokens; unknown ones are merged by the library."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        spec = pb.ModelProto()
        with open(model_file, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        pieces = [p.piece for p in spec.pieces if p.type == pb.ModelProto.SentencePiece.NORMAL]
        #: Cutting is proven harmless: text is not rewritten, no piece has a space inside, none but "\n" itself holds "\n".
        self.cuts = (not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
                     and not spec.trainer_spec.treat_whitespace_as_suffix
                     and not any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in spec.pieces)
                     and not any(re.search(f"[^{SPACE}]{SPACE}", p) or (len(p) > 1 and "\n" in p) for p in pieces))
        if self.cuts:
            self.bare_newline = len(self.sp.encode("\n"))
            self.newline = self.bare_newline - 1
            whole = [p.replace(SPACE, " ") for p in pieces]
            self.proven = {p: 1 for p in whole if re.fullmatch(r" *[^ \n]+| +", p) and self.merge(p) == 1}
            self.reset()

    def reset(self) -> None:
        self.clear()
        self.update(self.proven)
        self["\n"] = self.newline
        self[" "] = 1

    def merge(self, token: str) -> int:
        """Tokens of a pre-token; the library puts a space before a text, which the cut form has or must not have."""
        if token == " ":
            return 1
        if token[0] == " ":
            return len(self.sp.encode(token[1:]))
        return len(self.sp.encode("\n" + token)) - self.bare_newline

    def __missing__(self, token: str) -> int:
        n = self.merge(token)
        if len(token) <= MEMO_CHARS:
            if len(self) >= MEMO_SIZE + len(self.proven):
                self.reset()
            self[token] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.cuts:
            return len(self.sp.encode(text))
        return sum(map(self.__getitem__, re.findall(r" *[^ \n]+| +|\n", " " + text.replace(SPACE, " "))))


_loaded: dict[str, Shortcut] = {}


def shortcut(model_file: str) -> Shortcut:
    """The worker's own copy; the proof runs once per worker process."""
    if model_file not in _loaded:
        _loaded[model_file] = Shortcut(model_file)
    return _loaded[model_file]


def n_tokens(text: Column, model_file: str | None = None) -> Column:
    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import public_tokenizers

        s = shortcut(model_file or public_tokenizers.path("piece_bpe_32k.model"))
        for texts in batches:
            yield pd.Series([s.count(t) for t in texts], dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, limit: int = 4096, key: str = "doc_id", text: str = "text", model_file: str | None = None) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` for every row, whatever its length.

    A null text is empty (no bytes, no tokens); repeated rows and null keys are kept; other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return (docs.select(F.col(key), F.octet_length(body).cast("bigint").alias("n_bytes"), n_tokens(body, model_file).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
