"""Row shapes shared by the whole package."""

from pyspark.sql import types as T

CONDITION = T.StructType(
    [
        T.StructField("ecName", T.StringType()),
        T.StructField("ecCSSSelector", T.StringType()),
        T.StructField("ecTextCondition", T.StringType()),
        T.StructField("ecRuleCSSSelector", T.StringType()),
    ]
)

RULE = T.StructType(
    [
        T.StructField("ruleName", T.StringType()),
        T.StructField("ruleDescription", T.StringType()),
        T.StructField("ruleURLActivationCondition", T.ArrayType(T.StringType())),
        T.StructField("ruleTarget", T.StringType()),
        T.StructField("rulePreconditionType", T.StringType()),
        T.StructField("rulePreconditionExpression", T.StringType()),
        T.StructField("rulePreconditions", T.ArrayType(CONDITION)),
        T.StructField("ruleCSSSelector", T.StringType()),
        T.StructField("ruleTargetAttribute", T.StringType()),
        T.StructField("ruleContentCondition", T.StringType()),
        T.StructField("ruleMatchPreconditions", T.ArrayType(CONDITION)),
        T.StructField("ruleReturnsMore", T.BooleanType()),
        T.StructField("ruleReturnedMatchPos", T.IntegerType()),
        T.StructField("rulePostCSSSelector", T.ArrayType(T.StringType())),
        T.StructField("ruleReturnedValueNames", T.ArrayType(T.StringType())),
        T.StructField("ruleRemoveChars", T.ArrayType(T.StringType())),
    ]
)

LIBRARY = T.StructType(
    [
        T.StructField("libraryDescription", T.StringType()),
        T.StructField("csvLineFormat", T.ArrayType(T.StringType())),
        T.StructField("requiredFilledFields", T.ArrayType(T.StringType())),
        T.StructField("allowedMinimumFilled", T.DoubleType()),
        T.StructField("library", T.ArrayType(RULE)),
    ]
)

# one element of a parsed page; `idx` is its position in document order
NODE = T.StructType(
    [
        T.StructField("idx", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("prev", T.IntegerType()),
        T.StructField("nth", T.IntegerType()),
        T.StructField("sub_end", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("c0", T.IntegerType()),
        T.StructField("c1", T.IntegerType()),
        # text not shown: script and style, and the outermost of head, title and meta
        T.StructField("unseen", T.BooleanType()),
    ]
)

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

CAPTURES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("html", T.StringType()),
    ]
)

FRONTIER = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("fetched", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("contenttype", T.StringType()),
        T.StructField("contentlength", T.LongType()),
        T.StructField("lastmodified", T.StringType()),
        T.StructField("hash", T.StringType()),
        # place in the queue; files of other origin may lack these
        T.StructField("seq", T.LongType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("discovered_from", T.StringType()),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("started", T.TimestampType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("elapsed_s", T.DoubleType()),
        T.StructField("nproc", T.LongType()),
        T.StructField("nextracted", T.LongType()),
        T.StructField("qsize", T.LongType()),
        T.StructField("avgpps", T.DoubleType()),
        T.StructField("outputfile", T.StringType()),
    ]
)

# Frontier status codes below zero and their meaning.
STATUS_LABELS = {
    -1: "pending",
    -4: "connection failed",
    -5: "unreadable status (static fetch)",
    -6: "unreadable status (rendered fetch)",
    -7: "timeout",
    -8: "too many redirects",
    -9: "TLS error",
    -11: "scheme not allowed",
    -666: "rendering failed",
    -667: "too many network errors",
    -700: "content type not allowed",
    -999: "empty body",
}
PENDING = -1
NOT_CAPTURED = -4
BAD_SCHEME = -11
BAD_CONTENT_TYPE = -700
EMPTY_BODY = -999
