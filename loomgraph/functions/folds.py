"""Order-dependent folds over one text or one document, as plain functions.

Column forms wrap them in Arrow-batched UDFs; the functions themselves are ordinary Python and tested as such.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SENTENCES = re.compile("(?<=[。！？\n])")


def split_text(text: str, most: int, repeat: bool = False) -> list[str]:
    """Whole sentences packed into pieces of at most *most* characters; a longer sentence is cut.

    *repeat* keeps an old quirk: what was pending before an over-long sentence is emitted twice.
    """
    out: list[str] = []
    held = ""
    for sentence in filter(None, _SENTENCES.split(text or "")):
        if len(held) + len(sentence) <= most:
            held += sentence
            continue
        if held:
            out.append(held)
        if len(sentence) <= most:
            held = sentence
            continue
        out += [sentence[i : i + most] for i in range(0, len(sentence), most)]
        if not repeat:
            held = ""
    if held:
        out.append(held)
    return out


def merge_segments(segments: list[tuple[str, str]], least: int = 1000, most: int = 20_000) -> list[tuple[str, str]]:
    """Neighbouring (title, text) segments joined while one is short and the sum fits."""
    out: list[tuple[str, str]] = []
    title = text = ""
    for t, s in segments:
        if text and (len(text) < least or len(s) < least) and len(text) + len(s) + 2 <= most:
            title, text = (f"{title} / {t}" if t and t != title else title), f"{text}\n\n{s}"
            continue
        if text:
            out.append((title, text))
        title, text = t, s
    if text:
        out.append((title, text))
    return out


def page_groups(tokens: list[int], most: int = 20_000, overlap: int = 1) -> list[tuple[int, int]]:
    """Page ranges [first, last] of about equal token counts, each repeating the last page of the one before."""
    total = sum(tokens)
    if total <= most:
        return [(0, len(tokens) - 1)] if tokens else []
    parts = -(-total // most)
    goal = -(-(total / parts + most) // 2)
    out, first, held = [], 0, 0
    for i, n in enumerate(tokens):
        if held and held + n > goal:
            out.append((first, i - 1))
            first = max(i - overlap, 0)
            held = sum(tokens[first:i])
        held += n
    out.append((first, len(tokens) - 1))
    return out


def split_point(text: str, reach: int = 500) -> int:
    """Where to halve a text: a sentence end near the middle, looked for after it first, then before."""
    middle = len(text) // 2
    for i in range(middle, min(len(text), middle + reach)):
        if text[i] in "。！？\n.!?":
            return i + 1
    for i in range(middle - 1, max(0, middle - reach) - 1, -1):
        if text[i] in "。！？\n.!?":
            return i + 1
    return middle


def json_content(text: str) -> str:
    """What a fenced block holds, or the text itself."""
    m = re.search(r"```(?:json)?\s*(.*?)(?:```|$)", text or "", re.S)
    return (m[1] if m else text or "").strip()


def extract_json(text: str):
    """Parse JSON out of an answer: fences stripped, None as null, trailing commas dropped on a second try."""
    body = json_content(text).replace("None", "null")
    for candidate in (body, re.sub(r",(\s*[}\]])", r"\1", " ".join(body.split()))):
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    return {}


def _objects(text: str, key: str) -> list | None:
    m = re.search(rf'"{key}"\s*:\s*\[', text)
    if not m:
        return None
    found, at, decoder = [], m.end(), json.JSONDecoder()
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at >= len(text) or text[at] != "{":
            return found
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            return found
        found.append(value)


def repair_json(text: str):
    """The value of a truncated JSON text: complete entity and relation objects first, else closed brackets.

    Returns None if nothing can be read.
    """
    body = json_content(text)
    try:
        return json.loads(body)
    except ValueError:
        pass
    parts = {k: _objects(body, k) for k in ("entities", "relationships")}
    if any(v is not None for v in parts.values()):
        return {k: v or [] for k, v in parts.items()}
    for end, closing in reversed(_cuts(body)):
        try:
            return json.loads(body[:end].rstrip().rstrip(",") + closing)
        except ValueError:
            continue
    return None


def _cuts(text: str) -> list[tuple[int, str]]:
    """Where a text may be cut, after a value or a bracket, and the brackets that are open there, innermost first.

    One pass; a name in an object is no place to cut, so the last place is nearly always one that parses, and few are tried.
    """
    found, open_, inside, escaped, name = [], "", False, False, False
    for at, c in enumerate(text):
        if inside:
            inside = escaped or c != '"'
            escaped = not escaped and c == "\\"
            if not inside and not name:
                found.append((at + 1, open_))
        elif c == '"':
            inside = True
        elif c in "{[":
            open_ = ("}" if c == "{" else "]") + open_
            name = c == "{"
            found.append((at + 1, open_))
        elif c in "}]":
            if not open_.startswith(c):
                return found
            open_, name = open_[1:], False
            found.append((at + 1, open_))
        elif c == ",":
            found.append((at, open_))
            name = open_.startswith("}")
        elif c == ":":
            name = False
    return found if inside or name else [*found, (len(text), open_)]


ALIASES = {"entities": ("entities", "entity"), "relationships": ("relationships", "relations", "relation")}


def canonical(found: dict) -> dict:
    """Entities and relationships under any of their names."""
    return {k: next((found[a] for a in names if isinstance(found.get(a), list)), []) for k, names in ALIASES.items()}


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_text_udf(texts: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([split_text(t or "", int(m)) for t, m in zip(texts, most)])


@F.pandas_udf(T.StringType())
def repair_json_udf(texts: pd.Series) -> pd.Series:
    done = (repair_json(t or "") for t in texts)
    return pd.Series([None if v is None else json.dumps(v, ensure_ascii=False, sort_keys=True) for v in done])
