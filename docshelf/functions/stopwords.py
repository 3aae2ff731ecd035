"""English stop words.

The default list is Spark's own (the one ``StopWordsRemover`` loads), read
from the MLlib jar that ships with PySpark so it is available without a JVM
(the SQL oracle needs it too). Callers may pass any other list.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile

_RESOURCE = "org/apache/spark/ml/feature/stopwords/english.txt"


@functools.lru_cache(maxsize=1)
def english_stop_words() -> tuple[str, ...]:
    import pyspark

    jars = os.path.join(os.path.dirname(pyspark.__file__), "jars")
    spark_home = os.environ.get("SPARK_HOME")
    candidates = glob.glob(os.path.join(jars, "spark-mllib_*.jar"))
    if spark_home:
        candidates += glob.glob(os.path.join(spark_home, "jars", "spark-mllib_*.jar"))
    for jar in candidates:
        with zipfile.ZipFile(jar) as z:
            if _RESOURCE in z.namelist():
                words = z.read(_RESOURCE).decode("utf-8").split()
                return tuple(dict.fromkeys(w.strip().lower() for w in words if w.strip()))
    raise FileNotFoundError("Spark MLlib stop-word list not found next to pyspark")


def token_stop_words(stop_words: tuple[str, ...] | None = None) -> tuple[str, ...]:
    """The list restricted to entries that can ever be a token (>= 2 word chars)."""
    import re

    words = stop_words if stop_words is not None else english_stop_words()
    pat = re.compile(r"^\w{2,}$")
    return tuple(w for w in words if pat.match(w))
