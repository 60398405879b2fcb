import os
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

#: Nulls, an empty text, repeated rows, ties, a long text, and columns whose names the operators use inside.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog, again and again."),
    (2, "The quick brown fox jumps over the lazy dog, again and again."),
    (3, None),
    (4, ""),
    (4, ""),
    (None, "A text without an id stands here for itself alone."),
    (None, None),
    (5, " \t\n "),
    (6, "wörter " * 20_000),
    (7, "x"),
    (8, "Ein anderer Text, ganz ohne Bezug zu den vorigen; er steht für sich."),
    (8, "Ein anderer Text, ganz ohne Bezug zu den vorigen; er steht für sich."),
    (8, "The same id with another text."),
]
EXTRA = "d long, th long, fp long, component string, block int, node long, id string, mark long, score double, value string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with the odd cases and clashing columns."""
    rows = [(i, t, "en", *(None,) * 10) for i, t in TEXTS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
