"""Column layouts that the operators share."""

from pyspark.sql import types as T

# fixed values: defaults of the data model
VOCAB_SIZE = 60_000
VOCAB_MIN_FREQ = 3
UNK_TOKEN = "<UNK>"
START_TOKEN = "<S>"
END_TOKEN = "</S>"
N_CONTEXT = 4
MAX_SEQUENCE_LENGTH = 256
SUBSAMPLE_THRESHOLD = 1e-4
EMBED_DIMENSION = 300
EMBED_MAX_NORM = 1.0
NEG_SAMPLE_POWER = 0.75
NEG_SAMPLE_COUNT = 5
N_SHARDS = 32
SEED = 1337
SPLIT_SHARES = {"train": 0.75, "val": 0.15, "test": 0.10}
EPOCHS = 50
LEARNING_RATE = 0.025
CHECKPOINT_EVERY = 5
LOG_EVERY = 25

CORPUS = T.StructType(
    [T.StructField("record_id", T.LongType(), False), T.StructField("text", T.StringType(), True)]
)
SENTENCES = T.StructType(
    [
        T.StructField("record_id", T.LongType(), False),
        T.StructField("sent_no", T.IntegerType(), False),
        T.StructField("text", T.StringType(), False),
    ]
)
COUNTS = T.StructType([T.StructField("word", T.StringType(), False), T.StructField("cnt", T.LongType(), False)])
VOCABULARY = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("word", T.StringType(), False),
        T.StructField("cnt", T.LongType(), True),
        T.StructField("is_special", T.BooleanType(), False),
        T.StructField("is_infrequent", T.BooleanType(), False),
    ]
)
METRICS = T.StructType(
    [
        T.StructField("run", T.StringType(), False),
        T.StructField("phase", T.StringType(), False),
        T.StructField("epoch", T.IntegerType(), False),
        T.StructField("step", T.IntegerType(), True),
        T.StructField("loss", T.DoubleType(), True),
    ]
)
