"""Functions of the JVM that are kept as Java source beside this package's modules.

Where an operator steps through bytes or characters one by one, neither SQL nor
numpy has words for it. Such a loop is a Java file here; the compiler that Spark
carries for its own generated code compiles it on the driver, the classes go into a
jar in the shared folder, which Spark sends to all executors, and the functions are
registered with the session. They take and give SQL values, so they stand in plans
like built-in ones.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import shared_dir


def register(spark: SparkSession, source: str, functions: dict[str, tuple[str, str]]) -> None:
    """Make functions known to the session: name -> (nested class of ``source``.java, result type).

    Executors that start later get the jar as well.
    """
    if all(spark.catalog.functionExists(name) for name in functions):
        return
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
    compiler.cook(Path(__file__).with_name(f"{source}.java").read_text())
    classes, made = compiler.getBytecodes(), io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        for name in sorted(classes):
            z.writestr(zipfile.ZipInfo(name.replace(".", "/") + ".class"), bytes(classes[name]))
    jar = made.getvalue()
    path = f"{shared_dir(spark)}/chronoloom-{source}-{hashlib.sha256(jar).hexdigest()[:16]}.jar"
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at)
    out.write(jar)
    out.close()
    spark.sql(f"ADD JAR '{path}'")
    for name, (kind, result) in functions.items():
        new = compiler.getClassLoader().loadClass(f"chronoloom.llm.{source}${kind}").getConstructors()[0]
        spark._jsparkSession.udf().register(name, new.newInstance(gateway.new_array(jvm.Object, 0)), jvm.org.apache.spark.sql.types.DataType.fromDDL(result))


def call(name: str, *arguments: Column) -> Column:
    return F.call_function(name, *arguments)
