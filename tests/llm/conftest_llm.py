import glob
import os
import re

import pytest

import paperlantern.llm

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text[, lang[, source]]) as a documents table."""

    def make(rows):
        full = [(*r, *("en", "s")[len(r) - 2 :]) if len(r) < 4 else tuple(r) for r in rows]
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], DOCUMENTS)

    return make


def names_inside():
    """Every plain column name that the operators give something with ``alias`` or ``withColumn``."""
    found = set()
    for file in glob.glob(f"{os.path.dirname(paperlantern.llm.__file__)}/*.py"):
        with open(file) as f:
            found |= set(re.findall(r"""(?:alias|withColumn|withColumnRenamed|toDF)\("([a-z]\w*)\"""", f.read()))
    return found - {"doc_id", "text", "lang", "source", "n_chars"}


@pytest.fixture
def clashing(documents):
    """The same with columns named like those that the operators use inside."""
    names = sorted(names_inside())

    def make(rows):
        from pyspark.sql import functions as F

        return documents(rows).withColumns({n: F.lit("x") for n in names})

    return make


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
