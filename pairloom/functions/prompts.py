"""Prompt templates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.schemas import CODE_TASK, DOC_TASK, TASK_FORMATS

# Prompt texts sent to chat and judge models.
CHAT_CODE = (
    "Write a Python function for the following task. "
    "Return ONLY the function definition. No explanation, no examples, "
    "no markdown fences.\n\nTask: "
)
CHAT_DOCSTRING = (
    "Write a brief docstring for the following Python function. "
    "Return ONLY the docstring text, no quotes, no code, no markdown.\n\n"
)
JUDGE_CODE = (
    "Rate the quality of generated Python code against a reference.\n\nTask: ",
    "\n\nReference:\n```python\n",
    "\n```\n\nGenerated:\n```python\n",
    "\n```\n\n"
    "1 = Wrong / does not define expected function\n"
    "2 = Related but has bugs\n"
    "3 = Mostly correct, fails edge cases\n"
    "4 = Correct, minor style differences\n"
    "5 = Functionally equivalent or better\n\n"
    "Respond with ONLY a single integer (1-5):",
)
JUDGE_DOCSTRING = (
    "Rate a generated docstring against a reference.\n\nFunction:\n```python\n",
    "\n```\n\nReference docstring: ",
    "\nGenerated docstring: ",
    "\n\n"
    "1 = Wrong or irrelevant\n"
    "2 = Vaguely related, missing key details\n"
    "3 = Describes function but incomplete\n"
    "4 = Good, minor omissions\n"
    "5 = Comprehensive and accurate\n\n"
    "Respond with ONLY a single integer (1-5):",
)


def training_prompt(task: Column, text: Column) -> Column:
    """Training format of the task; an unknown task leaves the text alone."""
    out = F.when(F.lit(False), text)
    for name, (head, tail) in TASK_FORMATS.items():
        out = out.when(task == name, F.concat(F.lit(head), text, F.lit("\n" + tail)))
    return out.otherwise(text)


def chat_prompt(task: Column, text: Column) -> Column:
    return F.when(task == CODE_TASK, F.concat(F.lit(CHAT_CODE), text)).when(
        task == DOC_TASK, F.concat(F.lit(CHAT_DOCSTRING), text)
    )


def judge_prompt(task: Column, source: Column, reference: Column, generated: Column) -> Column:
    """Rating request; ``source`` is the task text or the code to describe."""

    def fill(parts: tuple[str, ...]) -> Column:
        a, b, c, d = (F.lit(p) for p in parts)
        return F.concat(a, source, b, reference, c, generated, d)

    return F.when(task == CODE_TASK, fill(JUDGE_CODE)).when(task == DOC_TASK, fill(JUDGE_DOCSTRING))
