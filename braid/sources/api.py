"""Profiles of a code host: user objects with their repositories, from JSON files or over REST."""
from __future__ import annotations

import json
import os
import re
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from braid.functions.scalars import first_of, let

USER = "struct<login:string,name:string,bio:string,location:string,blog:string,html_url:string>"
REPOS = "array<struct<name:string,language:string,stargazers_count:bigint,fork:boolean>>"
TOP_REPOS = 10
#: Fixed values of the service.
API, PER_PAGE, TIMEOUT_S = "https://api.github.com", 30, 10


def top_repos(repos: Column, n: int = TOP_REPOS) -> Column:
    """Names of the n repositories with most stars that aren't forks; the earlier of equals. Those without a name are dropped last."""
    own = F.filter(repos, lambda r: ~F.coalesce(r["fork"], F.lit(False)))
    ranked = F.array_sort(F.transform(own, lambda r, i: F.struct((-F.coalesce(r["stargazers_count"], F.lit(0))).alias("less"), i.alias("i"), r["name"].alias("name"))))
    return F.transform(F.filter(F.slice(ranked, 1, n), lambda r: r["name"] != ""), lambda r: r["name"])


def languages(repos: Column) -> Column:
    """Languages by number of repositories, forks included; the one met first of equals."""
    used = F.filter(F.transform(repos, lambda r, i: F.struct(r["language"].alias("name"), i.alias("i"))), lambda x: x["name"] != "")

    def counted(xs: Column) -> Column:
        starts = F.filter(F.transform(xs, lambda x, j: F.struct(j.alias("j"), x["i"].alias("i"), x["name"].alias("name"))), lambda x: (x["j"] == 0) | (x["name"] != F.get(xs, x["j"] - 1)["name"]))
        return let(starts, lambda ys: F.transform(ys, lambda y, k: F.struct((y["j"] - F.coalesce(F.get(ys, k + 1)["j"], F.size(xs))).alias("less"), y["i"].alias("i"), y["name"].alias("name"))))

    return F.transform(F.sort_array(let(F.sort_array(used), counted)), lambda x: x["name"])


def user_profiles(df: DataFrame, key: str | None = None) -> DataFrame:
    """Source profiles of rows with a user struct and an array of repos."""
    u = F.col("user")
    return df.select(
        (F.coalesce(u["login"], u["html_url"]) if key is None else F.col(key)).cast("string").alias("candidate_key"),
        first_of(u["name"], u["login"]).alias("name"),
        u["bio"].alias("bio"),
        u["location"].alias("location_raw"),
        first_of(u["blog"], u["html_url"]).alias("website"),
        u["html_url"].alias("profile_url"),
        top_repos(F.col("repos")).alias("github_repos"),
        languages(F.col("repos")).alias("github_languages"),
    )


def parsed(df: DataFrame, text: str) -> DataFrame:
    """user and repos of a JSON text: {"user": ..., "repos": [...]} or a bare user object."""
    both = F.from_json(F.col(text), f"user {USER}, repos {REPOS}")
    bare = F.from_json(F.col(text), USER[7:-1].replace(":", " "))
    return df.withColumn("user", F.coalesce(both["user"], bare.cast(USER))).withColumn("repos", F.coalesce(F.when(both["user"].isNotNull(), both["repos"]), F.array().cast(REPOS)))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One file is one user."""
    return user_profiles(parsed(spark.read.text(path, wholetext=True), "value"))


def username(url_or_name: str) -> str:
    found = re.search(r"github\.com/([^/\s?#]+)", url_or_name)
    return found[1] if found else url_or_name.strip().lstrip("@")


def username_column(x: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(x, r"github\.com/([^/\s?#]+)", 1), F.lit("")), F.regexp_replace(F.trim(x), "^@+", ""))


class _User(InputPartition):
    def __init__(self, name: str):
        self.name = name


class RestReader(DataSourceReader):
    def __init__(self, options):
        self.names = [n for n in options.get("users", "").split(",") if n.strip()]
        self.api = options.get("api", API).rstrip("/")

    def partitions(self):
        return [_User(username(n)) for n in self.names]

    def get(self, path: str):
        headers = {"Accept": "application/vnd.github+json", "X-GitHub-Api-Version": "2022-11-28"}
        if token := os.environ.get("GITHUB_TOKEN"):
            headers["Authorization"] = f"Bearer {token}"
        with urllib.request.urlopen(urllib.request.Request(self.api + path, headers=headers), timeout=TIMEOUT_S) as answer:
            return answer.read().decode()

    def read(self, partition):
        """A failing request gives an empty profile, which still counts as a source."""
        name = urllib.parse.quote(partition.name)
        try:
            user, repos = self.get(f"/users/{name}"), self.get(f"/users/{name}/repos?sort=pushed&per_page={PER_PAGE}")
            yield partition.name, json.dumps({"user": json.loads(user), "repos": json.loads(repos)})
        except (OSError, ValueError):
            yield partition.name, '{"user": {}, "repos": []}'


class RestSource(DataSource):
    """format("user_api"): option users, comma-separated names or addresses; option api, the service's address."""

    @classmethod
    def name(cls):
        return "user_api"

    def schema(self):
        return "login string, value string"

    def reader(self, schema):
        return RestReader(self.options)


def read_rest(spark: SparkSession, users: list[str], api: str = API) -> DataFrame:
    spark.dataSource.register(RestSource)
    rows = spark.read.format("user_api").option("users", ",".join(users)).option("api", api).load()
    return user_profiles(parsed(rows, "value"), key="login")


def read_users(spark: SparkSession, path_or_name: str) -> DataFrame:
    """An existing .json file is read; anything else is a user's name or address."""
    if os.path.exists(path_or_name) and path_or_name.endswith(".json"):
        return read_json(spark, path_or_name)
    return read_rest(spark, [path_or_name])
