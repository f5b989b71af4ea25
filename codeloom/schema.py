"""Column contracts shared by the operators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINDING = T.StructType(
    [
        T.StructField("rule_id", T.StringType(), False),
        T.StructField("analyzer", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("file", T.StringType(), False),
        T.StructField("line", T.LongType(), False),
        T.StructField("col", T.LongType()),
        T.StructField("end_line", T.LongType()),
        T.StructField("end_col", T.LongType()),
        T.StructField("code_snippet", T.StringType()),
        T.StructField("suggestion", T.StringType()),
    ]
)
FINDING_COLUMNS = FINDING.fieldNames()

# Syntax nodes are an input table. Intervals nest: the descendants of a node are the
# rows of the same path whose `pre` lies in (pre, post]. `field` is the name under which
# the parent finds this node, set on the first child of that name only. Store the table
# partitioned by `kind`: detectors read a few kinds each.
NODE = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("language", T.StringType(), False),
        T.StructField("node_id", T.LongType(), False),
        T.StructField("parent_id", T.LongType()),
        T.StructField("field", T.StringType()),
        T.StructField("kind", T.StringType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("pre", T.LongType(), False),
        T.StructField("post", T.LongType(), False),
        T.StructField("named", T.BooleanType(), False),
        T.StructField("start_line", T.LongType(), False),
        T.StructField("end_line", T.LongType(), False),
    ]
)


def findings(
    df: DataFrame,
    *,
    rule_id,
    analyzer: str,
    severity,
    message: Column,
    file,
    line,
    **optional,
) -> DataFrame:
    """Project `df` to the finding columns; strings for `file`/`line` name columns."""
    required = {
        "rule_id": F.lit(rule_id) if isinstance(rule_id, str) else rule_id,
        "analyzer": F.lit(analyzer),
        "severity": F.lit(severity) if isinstance(severity, str) else severity,
        "message": message,
        "file": F.col(file) if isinstance(file, str) else file,
        "line": F.col(line) if isinstance(line, str) else line,
    }
    values = {**required, **optional}
    return df.select(
        *[
            values.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in FINDING.fields
        ]
    )
