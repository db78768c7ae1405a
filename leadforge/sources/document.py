"""One sorted JSON document from a table: parts are written in parallel by ranges of the order, then joined end to end by the file system.

Each task writes the lines of one range, so no task and no memory follows the number of rows; joining streams the parts through a small buffer into a hidden file,
which gets its name by a rename when it is complete. A document that exists is replaced; a run that is cut off leaves it as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUFFER = 1 << 20


def write_document(df: DataFrame, path: str, order: list[Column], rows: str = "leads", head: dict | None = None, parts: int | None = None) -> None:
    """Writes ``{head.., rows: [..]}`` with a row of ``df`` on each line, in ``order``; nulls are written. Rows that the order does not tell apart may come in any order."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    # a comma before each row: the first one's is left out when the parts are joined
    lines = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.concat(F.lit(","), body).alias("value"))
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    lines.write.text(folder)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path
    store = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = place(path)
    hidden = place(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    opening = json.dumps({**(head or {}), rows: []}, ensure_ascii=False).removesuffix("]}") + "\n"
    files = sorted((s.getPath().getName(), s.getPath()) for s in store.listStatus(place(folder)) if s.getPath().getName().startswith("part-") and s.getLen() > 0)
    out = store.create(hidden)
    out.write(bytearray(opening.encode()))
    for i, (_, file) in enumerate(files):
        part = store.open(file)
        if i == 0:
            part.read()
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, BUFFER, False)
        part.close()
    out.write(bytearray(b"]}\n"))
    out.close()
    store.delete(target, False)
    if not store.rename(hidden, target):
        raise OSError(f"{path} could not be put in place")
    store.delete(place(folder), True)
