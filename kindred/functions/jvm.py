"""Functions of pairs that run where pairs are joined: Java sources beside this module, compiled by the compiler that
Spark brings along for its own plans, and sent to the executors as a jar. Where a session gives no access to its
JVM there are none, and callers make pairs in blocks instead, with the same results."""

from __future__ import annotations

import contextlib
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _registered(spark: SparkSession, name: str, kind: str) -> bool:
    function = f"kindred_{name}"
    with contextlib.suppress(Py4JError, PySparkException, AttributeError, OSError):
        jvm = spark._jvm
        if not spark._jsparkSession.catalog().functionExists(function):
            compiler = jvm.org.codehaus.janino.SimpleCompiler()
            compiler.cook(Path(__file__).with_name(f"{name}.java").read_text())
            jar = Path(tempfile.mkdtemp(prefix="kindred-")).resolve() / f"{name}.jar"
            with zipfile.ZipFile(jar, "w") as z:
                for entry in compiler.getBytecodes().entrySet():
                    z.writestr(entry.getKey().replace(".", "/") + ".class", bytes(entry.getValue()))
            spark._jsparkSession.sessionState().resourceLoader().addJar(str(jar))
            made = spark._jsparkSession.sharedState().jarClassLoader().loadClass(f"kindred.{name}").newInstance()
            spark._jsparkSession.udf().register(function, made, spark._jsparkSession.parseDataType(f'"{kind}"'))
        return True
    return False


def jaro_winkler(spark: SparkSession) -> Callable[[Column, Column], Column] | None:
    """``similarity.jaro_winkler_bytes`` of two binary columns."""
    return (lambda a, b: F.call_function("kindred_JaroWinkler", a, b)) if _registered(spark, "JaroWinkler", "double") else None
