"""Subword encoders: pieces of words that SQL can repeat, and a SentencePiece model over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def stand_in_pieces(text: Column, most: int = 3) -> Column:
    """Pieces of at most ``most`` characters; a model-free encoder that SQL can repeat."""
    n = F.ceil(F.length(text) / most).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * most + 1, F.lit(most)))).otherwise(F.array().cast("array<string>"))


def stand_in_id(piece: Column) -> Column:
    """An id from 4 up, clear of the reserved ids 0 and 3."""
    return (F.conv(F.substring(F.md5(piece.cast("binary")), 1, 6), 16, 10).cast("long") % 31000 + 4).cast("int")


def ascii_pieces(text: Column) -> Column:
    """Pieces of an encoder that knows printable ASCII only and drops the rest, so some words come out short; for checks."""
    return stand_in_pieces(F.regexp_replace(text, "[^ -~]", ""))


#: A token of a text, its id, and the characters [b0, b1) of the text that it stands for.
TOKEN_LIST = "tokens array<struct<token:string,token_id:int,b0:bigint,b1:bigint>>, error string"


def character_tokens(covered: list[tuple[str, str]], text: str, unit_id: Callable[[str], int]) -> list[tuple[str, int, int, int]]:
    """(token, id, b0, b1) from an encoder's pieces, each with the characters of ``text`` that it covers.

    A character that the encoder spells in bytes comes as pieces of which only the last covers it; they are one token, the
    character itself. Pieces that cover nothing, as a mark before the text, are none. ValueError if the pieces do not cover
    the text.
    """
    out, at = [], 0
    for piece, own in covered:
        if not own:
            continue
        if not text.startswith(own, at):
            raise ValueError(f"no token covers the text from character {at} on")
        token = own if piece.startswith("<0x") else piece
        out.append((token, unit_id(token), at, at + len(own)))
        at += len(own)
    if at != len(text):
        raise ValueError(f"no token covers the text from character {at} on")
    return out


def sentencepiece_encoder(model_path: str) -> Callable[[Column], Column]:
    """A Column function from a whole text to struct TOKEN_LIST; the model loads once for each task, texts come in Arrow batches.

    Null is an empty text without tokens. A text that the model cannot cover has an error and no tokens.
    """

    @F.pandas_udf(TOKEN_LIST)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        old = tuple(map(int, sentencepiece.__version__.split(".")[:3])) < (0, 2, 3)
        kind = {"out_type": "immutable_proto"} if old else {"return_type": "proto"}
        for texts in batches:
            rows = []
            for text in texts:
                text = text or ""
                try:
                    covered = [(p.piece, p.surface) for p in sp.encode(text, **kind).pieces]
                    found = character_tokens(covered, text, sp.piece_to_id)
                    rows.append(([{"token": t, "token_id": i, "b0": a, "b1": b} for t, i, a, b in found], None))
                except ValueError as e:
                    rows.append((None, str(e)))
            yield pd.DataFrame(rows, columns=["tokens", "error"])

    return encode
