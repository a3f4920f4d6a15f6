"""One task from proposals to the full test: sample examples, propose tools, score each by conversations, test the best."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import jsonx, text
from rillflow.operators import dialogue, metrics, rows
from rillflow.operators.execute import ModelClient
from rillflow.sources import sinks
from rillflow.sources import tasks as task_source
from rillflow.sources.replay import batch_folder

#: Examples a proposal sees, questions it is scored on, and proposals of a task.
EXAMPLES, QUESTIONS, ATTEMPTS = 10, 100, 10
ASK = "Write one Python function that solves questions like these, in a python block, and its schema as a function tool, in a json block.\n\n"


def samples(train: DataFrame, attempts: int = ATTEMPTS, seed: int = 42) -> DataFrame:
    """(attempt, ordinal, question, answer, part): the examples and the test questions of each attempt, shuffled apart."""
    each = train.select("ordinal", "question", "answer", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"))
    each = each.withColumn("draw", F.concat_ws(":", "attempt", "ordinal"))  # another order for each attempt
    return rows.reference_and_test(each, "draw", "attempt", seed, EXAMPLES, QUESTIONS).drop("draw")


def propose(sampled: DataFrame, client: ModelClient, task: str, ask: str = ASK) -> DataFrame:
    """(task, attempt, code, schema) of the replies that hold code and a JSON schema."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "question", "answer"))), lambda e: F.struct(e["question"].alias("question"), e["answer"].alias("answer")))
    asked = sampled.where("part = 'reference'").groupBy("attempt").agg(F.concat(F.lit(ask), text.few_shot_block(listed)).alias("prompt")).withColumn("turn", F.col("attempt"))
    said = client.generate(asked)
    made = said.select(F.lit(task).alias("task"), "attempt", *[F.try_element_at(text.code_blocks("reply", kind), F.lit(1)).alias(name) for kind, name in (("python", "code"), ("json", "schema"))])
    return made.where("code IS NOT NULL AND schema IS NOT NULL").where(jsonx.is_json("schema"))


def score(proposals: DataFrame, sampled: DataFrame, client: dialogue.ChatClient, folder: str, task: str, system: str = "", **options: object) -> DataFrame:
    """proposals with hit, total, accuracy and usage, each on its own attempt's test questions."""
    asked = sampled.where("part = 'test'").join(proposals.select("attempt", "code", jsonx.tool_definitions("schema").alias("tools")), "attempt")
    asked = asked.select(F.struct("attempt", "ordinal").alias("key"), "question", F.col("answer").alias("target"), "code", "tools")
    log = dialogue.evaluate_dataset(asked, client, folder, task, system, **options)
    return proposals.join(metrics.accuracy(log.withColumn("attempt", F.col("key.attempt")), "attempt"), "attempt")


def run(train: DataFrame, test: DataFrame, task: str, client: ModelClient, chat: dialogue.ChatClient, folder: str, attempts: int = ATTEMPTS, system: str = "", artifacts: str | None = None, **options: object) -> dict:
    """The best tool's accuracy on its questions and on the test split; ValueError where no proposal can be scored.

    artifacts: where the proposals and the log of the test are appended.
    """
    spark = train.sparkSession
    path = f"{folder}/proposals"
    sampled = samples(train, attempts)
    propose(sampled, client, task).write.mode("overwrite").parquet(path)  # asked once, read often
    proposals = spark.read.parquet(path)
    scored = score(proposals, sampled, chat, folder, task, system, **options)
    best = rows.best_proposal(scored, "task")
    held = best.first()
    if held is None:
        raise ValueError(f"no proposal for {task} could be scored")
    result, log = dialogue.full_test(spark.createDataFrame([held], best.schema), test, chat, folder, task, system, **options)
    if artifacts:
        sinks.write_artifacts(proposals, f"{artifacts}/proposals")
        sinks.write_evaluation_log(log, f"{artifacts}/evaluations_log")
    return {"task": task, "attempt": held["attempt"], "validation_accuracy": held["accuracy"], **result.first().asDict()}


def baseline(test: DataFrame, task: str, chat: dialogue.ChatClient, folder: str, system: str = "", artifacts: str | None = None, **options: object) -> dict:
    """Accuracy without tools."""
    asked = test.select(F.col("ordinal").alias("key"), "question", F.col("answer").alias("target"), F.lit("").alias("code"), F.array().cast(jsonx.TOOLS).alias("tools"))
    log = dialogue.evaluate_dataset(asked, chat, folder, task, system, **options)
    if artifacts:
        sinks.write_evaluation_log(log, f"{artifacts}/baseline_evaluations_log")
    return {"task": task, **metrics.accuracy(log).first().asDict()}


class ChatModel:
    """A chat client as a client of single prompts."""

    def __init__(self, chat: dialogue.ChatClient) -> None:
        self.chat = chat

    def generate(self, prompts: DataFrame) -> DataFrame:
        message = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"), F.lit(None).cast("string").alias("name"), F.lit(None).cast(dialogue.CALLS).alias("tool_calls")))
        keyed = prompts.select(F.struct(*prompts.columns).alias("key"), message.alias("messages"), F.array().cast(jsonx.TOOLS).alias("tools"), F.lit("none").alias("choice"))
        return self.chat.chat(keyed).select("key.*", F.col("content").alias("reply"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rillflow.plans.experiment")
    parser.add_argument("--task", required=True, choices=sorted(task_source.BANDS))
    parser.add_argument("--base_url", required=True)
    parser.add_argument("--api_key", default="")
    parser.add_argument("--model_name", required=True)
    parser.add_argument("--experiment_dir", required=True, help="where proposals and logs are appended")
    parser.add_argument("--baseline", action="store_true", help="without tools")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    data = task_source.dataset(spark, args.task)
    train, test = (task_source.load_split(data, s) for s in (task_source.V, task_source.T))
    chat, folder = dialogue.model_chat(args.base_url, args.model_name, args.api_key), batch_folder(spark)
    if args.baseline:
        print(baseline(test, args.task, chat, folder, artifacts=args.experiment_dir))
    else:
        print(run(train, test, args.task, ChatModel(chat), chat, folder, artifacts=args.experiment_dir))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
