import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
_LONG = " ".join(f"word{i}" for i in range(30_000))
_PASSAGE = " ".join(f"shared{i}" for i in range(60))

#: Nulls, empty, blank and very long texts, ties and repeated rows, copies, private data.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b\x0c\r ", "en", "a", 7),
    (4, _LONG, "en", "b", len(_LONG)),
    (5, f"One two three. {_PASSAGE} four five.", "en", "b", 1),
    (6, f"{_PASSAGE} and then something of its own", "en", None, 1),
    (7, f"Quite other words before {_PASSAGE}", "en", "a", 1),
    (8, f"Quite other words before {_PASSAGE}", "en", "a", 1),
    (8, f"Quite other words before {_PASSAGE}", "en", "a", 1),
    (9, "mail me at a.b+c@x-y.example.org or @ or x@y or 1.2.3.4 999.1.1.1 +1 (555) 010-9999 4111 1111 1111 1111 endé b@c.de", "en", "c", 1),
    (10, "double  spaces\n\nand   odd blanks, it's <|endoftext|> 日本語 \U0001f600 é ", "en", "c", 1),
    (11, "a b c d e f g h " * 40, "en", "c", 1),
    (12, "x", "en", "c", 1),
    (None, f"no id {_PASSAGE}", "en", "c", 1),
    (13, "\x00 nul and \x1c separators \x85 here", "en", "c", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
