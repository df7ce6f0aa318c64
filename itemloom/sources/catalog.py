"""Course catalogue: users, courses, lessons, exams, questions and choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def courses_of(courses: DataFrame, user_id: str) -> DataFrame:
    """P1."""
    return courses.filter(F.col("user_id") == user_id).select("id", "title", "is_public")


def nest(parents: DataFrame, children: DataFrame, key: str, name: str, fields: list[str], parent: str = "id") -> DataFrame:
    """parents with their children as a sorted array; empty, never null (JN3, JN4)."""
    c = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    kind = c.schema[name].dataType.simpleString()
    return parents.join(c, F.col(parent) == F.col(key), "left").drop(key).withColumn(name, F.coalesce(name, F.array().cast(kind)))


def course_tree(courses: DataFrame, lessons: DataFrame, exams: DataFrame) -> DataFrame:
    """All courses with lessons with exams, in one plan (JN3)."""
    inner = nest(lessons, exams, "lesson_id", "exams", ["id", "title", "has_taken"])
    return nest(courses, inner, "course_id", "lessons", ["id", "title", "exams"])


def exam_questions(exams: DataFrame, questions: DataFrame, choices: DataFrame) -> DataFrame:
    """All exams with questions with choices, without the answer flag (JN4)."""
    inner = nest(questions, choices, "question_id", "choices", ["id", "content"])
    return nest(exams, inner, "exam_id", "questions", ["id", "content", "choices"])


def answer_key(questions: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(question to its correct choice, questions without one); of several the smallest id counts (JN5, G16)."""
    right = choices.filter("is_correct").groupBy("question_id").agg(F.min("id").alias("choice_id"))
    key = questions.join(right, F.col("id") == F.col("question_id")).select("exam_id", F.col("id").alias("question_id"), "choice_id")
    return key, questions.join(right, F.col("id") == F.col("question_id"), "left_anti").select("exam_id", F.col("id").alias("question_id"))


def with_taken(exams: DataFrame, attempts: DataFrame) -> DataFrame:
    """exams with has_taken from appended attempts instead of an update in place."""
    seen = attempts.select(F.col("exam_id").alias("seen")).distinct()
    return exams.drop("has_taken").join(seen, F.col("id") == F.col("seen"), "left").withColumn("has_taken", F.col("seen").isNotNull()).drop("seen")


#: Child table, its key, its parent.
CHAIN = (("courses", "user_id", "users"), ("lessons", "course_id", "courses"), ("exams", "lesson_id", "lessons"), ("questions", "exam_id", "exams"), ("choices", "question_id", "questions"))


def cascade_delete(tables: dict[str, DataFrame], user_ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without some users and all that hangs below them."""
    out = dict(tables)
    out["users"] = tables["users"].join(user_ids.select(F.col("id").alias("gone")), F.col("id") == F.col("gone"), "left_anti")
    for child, key, parent in CHAIN:
        alive = out[parent].select(F.col("id").alias("alive"))
        out[child] = tables[child].join(alive, F.col(key) == F.col("alive"), "left_semi")
    return out


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose parent is missing."""
    return child.join(parent.select(F.col(parent_key).alias("alive")), F.col(key) == F.col("alive"), "left_anti")
