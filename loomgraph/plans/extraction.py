"""Entities and relations out of text, and the pluggable language model behind it.

A model is a callable from a text to ``{"entities": [...], "relationships": [...]}``. The offline default is rule-based, so
every pipeline runs without a network. A call that fails gives no entities rather than losing the job, and a row of kind ``error`` that says why.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import folds
from ..operators.dedup import first_per

Model = Callable[[str], dict]
DIRECT, RETRY_OVER = 25_000, 2000
_NAME = re.compile(r"\b[A-ZÄÖÜÉ][\w'-]+(?:\s+[A-ZÄÖÜÉ][\w'-]+)*")
RESULT = "doc_id long, seq long, kind string, n string, t string, c int, s string, p string, o string"


def offline_model(text: str) -> dict:
    """Capitalised spans as entities, and a relation between neighbours of one sentence."""
    entities: dict[str, dict] = {}
    relations = []
    for sentence in re.split(r"(?<=[.!?。！？\n])", text):
        names = [m[0] for m in _NAME.finditer(sentence)]
        for n in names:
            entities.setdefault(n, {"n": n, "t": "concept", "c": 0})["c"] += 1
        relations += [{"s": a, "p": "co-occurs with", "o": b} for a, b in zip(names, names[1:]) if a != b]
    return {"entities": list(entities.values()), "relationships": relations}


def call(model: Model, text: str, tries: int = 3) -> dict:
    """The model's answer in canonical form; text answers are repaired and parsed; after *tries* failures nothing but the last ``error``."""
    error = "no answer"
    for _ in range(tries):
        try:
            found = model(text)
        except Exception as e:  # noqa: BLE001  a model may fail in any way
            error = f"{type(e).__name__}: {e}"
            continue
        error = "an answer that is no JSON object"
        if isinstance(found, str):
            found = folds.repair_json(found)
        if isinstance(found, dict):
            return folds.canonical(found)
    return {"entities": [], "relationships": [], "error": error}


def extract(model: Model, text: str, direct: int = DIRECT) -> dict:
    """Short texts at once, long ones in fixed slices; an empty answer on a long piece halves it at a sentence end."""
    if len(text) > direct:
        parts = [extract(model, text[i : i + direct], direct) for i in range(0, len(text), direct)]
    else:
        found = call(model, text)
        if found["entities"] or found["relationships"] or len(text) <= RETRY_OVER:
            return found | {"errors": [found["error"]] if "error" in found else []}
        cut = folds.split_point(text)
        parts = [extract(model, half, direct) for half in (text[:cut], text[cut:])]
    seen: dict[tuple, dict] = {}
    for e in (e for p in parts for e in p["entities"]):
        seen.setdefault((e.get("n"), e.get("t")), e)
    return {"entities": list(seen.values()), "relationships": [r for p in parts for r in p["relationships"]], "errors": [e for p in parts for e in p["errors"]]}


def extract_segments(segments: DataFrame, model: Model = offline_model) -> DataFrame:
    """Entity and relation rows of (doc_id, part, text) segments, in order of segment and place."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc_id, part, text in zip(f.doc_id, f.part, f.text):
                found = extract(model, text or "")
                items = [("entity", e) for e in found["entities"]] + [("relation", r) for r in found["relationships"]] + [("error", {"n": e}) for e in found["errors"]]
                rows += [(doc_id, int(part) * 1_000_000 + i, k, x.get("n"), x.get("t"), x.get("c"), x.get("s"), x.get("p"), x.get("o")) for i, (k, x) in enumerate(items)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return segments.select("doc_id", "part", "text").mapInPandas(run, RESULT)


def distinct_results(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (first of each name and type) and relations (first of each triple) over all segments."""
    order = [F.col("doc_id"), F.col("seq")]
    return first_per(rows.where("kind = 'entity'"), ["n", "t"], *order), first_per(rows.where("kind = 'relation'"), ["s", "p", "o"], *order)
