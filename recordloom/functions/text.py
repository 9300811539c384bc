"""JSON recovery, token counting and text normalisation as columns."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Pieces a byte-pair tokenizer starts from; written so that engines without
# look-around agree on it.
TOKEN_PIECE = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+|\s+"

_STRING = r'"[^"\\]*(?:\\.[^"\\]*)*"'

# Latin ligatures U+FB00..U+FB06 and what they stand for.
LIGATURES = {
    "ﬀ": "ff",
    "ﬁ": "fi",
    "ﬂ": "fl",
    "ﬃ": "ffi",
    "ﬄ": "ffl",
    "ﬅ": "st",
    "ﬆ": "st",
}


def expand_ligatures(text: Column) -> Column:
    for sign, letters in LIGATURES.items():
        text = F.replace(text, F.lit(sign), F.lit(letters))
    return text


def json_span(text: Column) -> Column:
    """From the first ``{`` to the last ``}``, across lines; "" without one."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


_END = "\ue000end\ue001"


def parse_object(span: Column) -> Column:
    """The single JSON object in ``span`` as a variant, NULL when there is none.

    The span is read as the first of two list elements: only when the mark
    behind it is read as the second one is the span one whole value. Raw control
    characters inside strings are accepted, ``NaN`` and the infinities are not.
    The variant is read from the span itself, which keeps reals exact; only a
    text with raw control characters takes the reader's re-escaped copy.
    """
    values = F.from_json(
        F.concat(F.lit("["), span, F.lit(f',"{_END}"]')),
        "array<string>",
        {
            "allowUnquotedControlChars": "true",
            "allowNonNumericNumbers": "false",
            "allowSingleQuotes": "false",
        },
    )
    whole = (F.size(values) == 2) & (F.get(values, F.lit(1)) == _END) & ~span.contains(_END)
    return F.when(
        whole, F.coalesce(F.try_parse_json(span), F.try_parse_json(F.get(values, F.lit(0))))
    )


def estimated_tokens(definition: Column) -> Column:
    """Built-in estimate of a definition's token count.

    Pieces of the compact text, plus one for each separator outside strings
    (the counted serialisation puts a space after every comma and colon, which
    starts another piece).
    """
    compact = F.regexp_replace(definition, rf"({_STRING})|\s+", "$1")
    pieces = F.size(F.regexp_extract_all(compact, F.lit(TOKEN_PIECE), F.lit(0)))
    bare = F.regexp_replace(compact, _STRING, "")
    return (pieces + F.length(F.regexp_replace(bare, "[^,:]", ""))).cast("int")


def exact_tokens(vocabulary_file: str, split_pattern: str):
    """Arrow-batched exact counter over a local byte-pair rank file.

    The rank file must be readable on every executor (ship it with
    ``spark.files`` or keep it on shared storage).
    """
    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe

        encoding = tiktoken.Encoding(
            "registry",
            pat_str=split_pattern,
            mergeable_ranks=load_tiktoken_bpe(vocabulary_file),
            special_tokens={},
        )

        def one(text: str | None) -> int | None:
            if text is None:
                return None
            try:
                text = json.dumps(json.loads(text))
            except ValueError:
                pass
            return len(encoding.encode_ordinary(text))

        for texts in batches:
            yield texts.map(one).astype("Int32")

    return count


def base64_text(data: Column) -> Column:
    """Base64 on one line, whatever line length the session encodes with."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def short_id(*parts: Column) -> Column:
    """Ten letters or digits that depend on nothing but ``parts``, so a rerun
    writes the same key again (about 60 bits)."""
    digest = F.base64(F.unhex(F.sha2(F.concat_ws("|", *parts), 256)))
    return F.substring(F.translate(digest, "+/", "ab"), 1, 10)
