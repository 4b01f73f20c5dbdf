"""Sources made from the parts table on which values contradict what takes them, or don't; and what they must give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A source, and its findings: code, line, function, name, severity. @ stands for the part's key; other texts are quiet.
CASES = (
    ("import time\ndef wait(delay_ms):\n    time.sleep(delay_ms)\n", (("BHUNIT004", 3, "wait", "time.sleep", "warning"),)),
    ("import time\ndef wait(delay_ms):\n    time.sleep(delay_ms / 1000)\n    pause_s = delay_ms / 1000\n    time.sleep(pause_s)\n", ()),
    ("import time\ndef wait(delay_ms):\n    x = delay_ms / 60\n    time.sleep(x)\n", (("BHUNIT004", 4, "wait", "time.sleep", "warning"),)),
    ("def ids(user_id):\n    load(user_id)\n\ndef load(order_id):\n    return order_id\n", (("BHSEM001", 2, "ids", "load", "warning"),)),
    ("def ids(user_id, own_user_id):\n    load(user_id)\n    load(own_user_id)\n\ndef load(user_id):\n    return user_id\n", ()),
    ("def at(start_at):\n    rest(start_at)\n\ndef rest(x_delay):\n    return x_delay\n", (("BHSEM002", 2, "at", "rest", "warning"),)),
    ("import datetime\ndef mixed():\n    a = datetime.datetime.now()\n    b = datetime.datetime.now(tz=utc)\n    c = a - b\n    return c\n", (("BHSEM003", 0, "mixed", "c", "error"), ("BHSEM003", 0, "mixed", "return@0", "error"))),
    ("import numpy\ndef cut():\n    a = numpy.zeros(9, dtype=numpy.float64)\n    b = a.astype(numpy.int8)\n    return numpy.ones(1)\n", (("BHSEM004", 0, "cut", "b", "error"),)),
    ("import numpy\ndef sum(n):\n    a = numpy.zeros(n, dtype='uint64')\n    b = numpy.ones(n, dtype=numpy.int64)\n    c = a + b\n    d = a * a\n", (("BHSEM005", 0, "sum", "c", "error"),)),
    ("import numpy\ndef form():\n    a = numpy.zeros((2, 3), dtype=numpy.int8)\n    b = a.reshape(5, 2)\n    c = a.reshape((3, 2))\n    d = a.reshape(-1, 2)\n", (("BHSEM006", 0, "form", "b", "warning"),)),
    ("def scale(x_pct):\n    take(x_pct)\n    y = x_pct / 100\n    take(y)\n\ndef take(y_ratio):\n    return y_ratio\n", (("BHSEM007", 2, "scale", "take", "warning"),)),
    ("def frame(p_world, q_camera):\n    draw(p_world)\n    draw(q_camera)\n\ndef draw(r_cam):\n    return r_cam\n", (("BHSEM008", 2, "frame", "draw", "warning"),)),
    ("import hashlib\ndef sign(text: str, data: bytes):\n    hashlib.md5(text)\n    hashlib.md5(text.encode())\n    hashlib.sha256(data)\n", (("BHSEM009", 3, "sign", "hashlib.md5", "error"),)),
    ("def maybe(d):\n    v = d.get('x')\n    v.run()\n    w = d.get('y')\n    if w is not None:\n        w.run()\n", (("BHSEM010", 3, "maybe", "v", "warning"),)),
    ("import time\ndef first(span_ms):\n    second(span_ms)\n\ndef second(t):\n    x = t\n    third(x)\n\ndef third(t):\n    u = t\n    time.sleep(u)\n", (("BHUNIT004", 11, "third", "time.sleep", "warning"),)),
    ("def add(a_ms, b_km):\n    c = a_ms + b_km\n    d = a_ms + a_ms\n    return d\n", (("BHUNIT004", 0, "add", "c", "warning"),)),
    ("from src@.far import give\nimport time\ndef ask():\n    t = give(1)\n    time.sleep(t)\n\ndef quiet():\n    time.sleep(give)\n", ()),
    ("import time\ndef give(n_ms):\n    return n_ms\n\ndef ask(m_ms):\n    t = give(m_ms)\n    time.sleep(t)\n", (("BHUNIT004", 7, "ask", "time.sleep", "warning"),)),
)


def sources(parts: DataFrame) -> DataFrame:
    """parts: p_partkey. path and source, one a part: its key picks the case."""
    spark = parts.sparkSession
    cases = F.broadcast(spark.createDataFrame([(k, text) for k, (text, _) in enumerate(CASES)], "k int, text string"))
    key = F.col("p_partkey").cast("string")
    picked = parts.select("p_partkey", (F.col("p_partkey") % len(CASES)).cast("int").alias("k")).join(cases, "k")
    return picked.select(F.concat(F.lit("src/v"), key, F.lit(".py")).alias("path"), F.replace("text", F.lit("@"), key).alias("source"))


def findings_sql() -> str:
    values = ", ".join(str((k, *f)) for k, (_, found) in enumerate(CASES) for f in found)
    return f"""SELECT code, 'src/v' || p_partkey || '.py' AS path, CAST(line AS INTEGER) AS line, function, name, severity
FROM part JOIN (VALUES {values}) v(k, code, line, function, name, severity) ON p_partkey % {len(CASES)} = k"""
