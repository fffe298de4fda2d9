"""Golden question sets: validation, frames, and evaluation reports as files."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.evaluation import SELECTOR_FIELDS

DEFAULT_KS = (5, 10)


@dataclass(frozen=True)
class GoldenSet:
    name: str
    repo: str
    store: str
    questions: tuple[tuple[str, tuple[dict, ...]], ...]  # text, selectors
    top_k: tuple[int, ...] = DEFAULT_KS
    index_name: str | None = None

    def question_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, q) for i, (q, _) in enumerate(self.questions)], "qid int, question string")

    def selector_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, *(s.get(f) for f in SELECTOR_FIELDS)) for i, (_, found) in enumerate(self.questions) for s in found]
        return spark.createDataFrame(rows, "qid int, " + ", ".join(f"{f} string" for f in SELECTOR_FIELDS))


def _text(raw: dict, key: str, source: str) -> str:
    value = raw.get(key)
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{source}: {key!r} must be a text that is not empty")
    return value


def cuts(value, source: str = "top_k") -> tuple[int, ...]:
    """Positive whole numbers, each once, in order; a text may list them with commas, in its own order."""
    if isinstance(value, str):
        return tuple(int(x) for x in value.split(",") if x.strip())
    if not isinstance(value, (list, tuple)) or not value or any(isinstance(k, bool) or not isinstance(k, int) or k <= 0 for k in value):
        raise ValueError(f"{source}: top_k must be a list of positive whole numbers")
    return tuple(sorted(set(value)))


def golden_set(raw: dict, source: str = "golden set") -> GoldenSet:
    if not isinstance(raw, dict):
        raise ValueError(f"{source}: must be an object")
    name, repo = _text(raw, "name", source), _text(raw, "repo", source)
    if not isinstance(raw.get("questions"), list) or not raw["questions"]:
        raise ValueError(f"{source}: 'questions' must be a list that is not empty")
    questions = []
    for i, q in enumerate(raw["questions"]):
        at = f"{source}, question {i + 1}"
        if not isinstance(q, dict):
            raise ValueError(f"{at}: must be an object")
        text, found = _text(q, "question", at), q.get("relevant")
        if not isinstance(found, list) or not found:
            raise ValueError(f"{at}: 'relevant' must be a list that is not empty")
        for s in found:
            if not isinstance(s, dict) or not s or set(s) - set(SELECTOR_FIELDS) or not any(s.values()):
                raise ValueError(f"{at}: a selector takes at least one of {', '.join(SELECTOR_FIELDS)} and nothing else")
        questions.append((text, tuple({k: v for k, v in s.items() if v} for s in found)))
    return GoldenSet(name, repo, raw.get("store") or "cosine", tuple(questions), cuts(raw.get("top_k", list(DEFAULT_KS)), source), raw.get("index_name"))


def load_golden_set(path: str) -> GoldenSet:
    with open(path) as f:
        return golden_set(json.load(f), path)


def write_report(report: dict, folder: str) -> str:
    """The report as {name}_{store}_{timestamp}.json; its path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{report['name']}_{report['store']}_{report['timestamp']}.json")
    with open(path, "w") as f:
        json.dump(report, f, indent=2, sort_keys=True)
    return path


def load_report(path: str) -> dict:
    with open(path) as f:
        return json.load(f)
