"""Column layouts and fixed values shared by all operators."""

from pyspark.sql import types as T

# They define the results and are not tunable.
TASK_FORMATS = {
    "task_1": ("Generate code: ", "Code: "),
    "task_2": ("Generate docstring: ", "Docstring: "),
    "code_generation": ("Generate code: ", "Code: "),
    "docstring_generation": ("Generate docstring: ", "Docstring: "),
}
PAIR_COLUMNS = {"task_1": ("text", "code"), "task_2": ("code", "docstring")}
SPLIT_ORDER = ("train", "validation", "test")
CODE_TASK = "code_generation"
DOC_TASK = "docstring_generation"
IGNORE_LABEL = -100
UNK_ID = 0
PAD_ID = 0
EOS_ID = 1
FIRST_TOKEN_ID = 2
TRAIN_FRACTION = 0.8
SPLIT_SEED = 42
MAX_PIECES = 600
FIRST_N = 1000
EVAL_TOKEN_LIMIT = 2048
APP_TOKEN_LIMIT = 1000
RESPONSE_LIMIT = 500
BLEU_ORDER = 4
BLEU_FLOOR = 1e-9
GATE_THRESHOLD = 0.02
GATE_METRICS = ("codegen_pass_rate", "codegen_quality (1-5)", "docgen_bleu")
METRICS = (
    "codegen_pass_rate",
    "codegen_bleu",
    "codegen_quality (1-5)",
    "docgen_bleu",
    "docgen_quality (1-5)",
    "avg_latency_ms",
    "avg_memory_mb",
)
HYPERPARAMETERS = (
    "learning_rate",
    "num_epochs",
    "batch_size",
    "gradient_accumulation_steps",
    "lora_r",
    "lora_alpha",
    "lora_dropout",
)

MODELS = ("candidate", "base", "cloud")
SKIPPED_NO_KEY = "SKIPPED (no API key)"

PAIRS = T.StructType(
    [
        T.StructField("ex_id", T.LongType()),
        T.StructField("task", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("answer", T.StringType()),
    ]
)

_IDS = T.ArrayType(T.IntegerType(), containsNull=False)
EXAMPLES = T.StructType(
    [
        T.StructField("ex_id", T.LongType()),
        T.StructField("input_ids", _IDS),
        T.StructField("attention_mask", _IDS),
        T.StructField("labels", _IDS),
        T.StructField("task", T.StringType()),
        T.StructField("part", T.StringType()),
    ]
)

# Inputs and expected values of test cases are JSON of any type.
EVAL_SAMPLE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("task", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("function_name", T.StringType()),
        T.StructField("reference_code", T.StringType()),
        T.StructField(
            "test_cases",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("input", T.VariantType()),
                        T.StructField("expected", T.VariantType()),
                    ]
                )
            ),
        ),
        T.StructField("code", T.StringType()),
        T.StructField("reference_docstring", T.StringType()),
    ]
)

FEEDBACK_RAW = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("rating", T.StringType()),
    ]
)
