"""Command line: list, find, count, distinct, group, schema, export, sql and a small prompt over a database folder."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from lodestone.collection import Database, discover
from lodestone.functions.values import iso
from lodestone.operators.updates import get_path
from lodestone.sources.documents import VALID, export_json
from lodestone.tools.inference import default_columns, describe_field, fields_of, infer_schema


def shown(value: Any) -> str:
    return json.dumps(value, default=iso, ensure_ascii=False)


def aligned(head: list[str], lines: list[list[str]]) -> str:
    """A table whose columns are as wide as what they hold; line ends within a cell become blanks."""
    cells = [[" ".join(c.split()) for c in line] for line in [head, *lines]]
    width = [max(len(line[i]) for line in cells) for i in range(len(head))]
    drawn = ["| " + " | ".join(c.ljust(w) for c, w in zip(line, width)) + " |" for line in cells]
    return "\n".join([drawn[0], "|" + "|".join("-" * (w + 2) for w in width) + "|", *drawn[1:]])


class Shell:
    """The commands; every one returns text."""

    def __init__(self, db: Database, page: int = 20, sample: int = 200):
        self.db, self.page, self.sample = db, page, sample
        self.current: str | None = None
        self.last: str = ""

    def target(self, name: str | None = None):  # noqa: ANN201
        name = name or self.current
        if not name:
            raise ValueError("choose a collection first: .use NAME")
        return self.db.collection(name)

    def collections(self) -> str:
        return "\n".join(f"{c['name']}\t{c['count']}" for c in self.db.list_collection_info()) or "no collections"

    def find(self, query: str = "{}", page: int = 0, name: str | None = None) -> str:
        cursor = self.target(name).find(json.loads(query)).sort({"_id": 1}).skip(page * self.page).limit(self.page)
        return "\n".join(shown(d) for d in cursor)

    def table(self, fields: str, query: str = "{}", page: int = 0, name: str | None = None) -> str:
        """Chosen fields (separated by commas) as an aligned table."""
        paths = [f.strip() for f in fields.split(",") if f.strip()]
        cursor = self.target(name).find(json.loads(query)).sort({"_id": 1}).skip(page * self.page).limit(self.page)
        return aligned(paths, [["" if (v := get_path(d, p)) is None else v if isinstance(v, str) else shown(v) for p in paths] for d in cursor])

    def count(self, query: str = "{}", name: str | None = None) -> str:
        return str(self.target(name).count_documents(json.loads(query)))

    def distinct(self, path: str, name: str | None = None) -> str:
        return "\n".join(shown(v) for v in self.target(name).distinct(path))

    def group(self, path: str, name: str | None = None) -> str:
        rows = self.target(name).aggregate([{"$group": {"_id": f"${path}", "count": {"$sum": 1}}}, {"$sort": {"count": -1}}]).limit(self.page).collect()
        return "\n".join(f"{r['_id']}\t{r['count']}" for r in rows)

    def schema(self, name: str | None = None) -> str:
        c = self.target(name)
        rows = c.rows()
        fields = fields_of(infer_schema(rows.where(VALID), "doc", self.sample) if c.documents else infer_schema(rows, None, self.sample))
        columns = set(default_columns(fields))
        return "\n".join(f"{'*' if f.path in columns else ' '} {f.path}: {describe_field(f)}" for f in fields)

    def export(self, path: str, query: str = "{}", limit: int | None = None, name: str | None = None) -> str:
        export_json(self.target(name).find(json.loads(query)).frame(), path, limit)
        return f"written to {path}"

    def sql(self, statement: str) -> str:
        df = self.db.sql(statement)
        return "\n".join(["\t".join(df.columns), *("\t".join(str(v) for v in r) for r in df.limit(self.page).collect())])

    def columns(self, name: str | None = None) -> str:
        """The columns that a table shows unless others are chosen."""
        c = self.target(name)
        return ",".join(default_columns(fields_of(infer_schema(c.rows().where(VALID), "doc", self.sample) if c.documents else infer_schema(c.rows(), None, self.sample))))

    def explain(self, query: str = "{}", name: str | None = None) -> str:
        return self.target(name).find(json.loads(query)).to_sql()

    def run(self, line: str) -> str:
        """One line of the prompt."""
        word, _, rest = line.strip().partition(" ")
        rest = rest.strip()
        if word == ".use":
            self.current = rest
            return f"using {rest}"
        actions: dict[str, Callable[[], str]] = {
            ".collections": self.collections,
            ".find": lambda: self.find(rest or "{}"),
            ".table": lambda: self.table(rest.split(" ")[0] or self.columns(), rest.partition(" ")[2] or "{}"),
            ".columns": self.columns,
            ".count": lambda: self.count(rest or "{}"),
            ".distinct": lambda: self.distinct(rest),
            ".group": lambda: self.group(rest),
            ".schema": self.schema,
            ".sql": lambda: self.sql(rest),
            ".plan": lambda: self.explain(rest or "{}"),
            ".sample": lambda: "\n".join(shown(d) for d in self.target().find().limit(int(rest or 5))),
            ".last": lambda: self.last,
            ".help": lambda: " ".join([".use", *actions]),
        }
        if word not in actions:
            return f"unknown command {word}; {actions['.help']()}"
        try:
            out = actions[word]()
        except Exception as error:  # a prompt goes on after a mistake
            return f"error: {error}"
        if word != ".last":
            self.last = out
        return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    parser.add_argument("-d", "--database", help="folder of the database; without it folders are searched for")
    parser.add_argument("-c", "--collection")
    parser.add_argument("-v", "--verbose", action="store_true", help="show Spark's warnings")
    parser.add_argument("--repl", action="store_true", help="start a prompt")
    parser.add_argument("--sample", type=int, default=200, help="documents read for the schema")
    parser.add_argument("--page-size", type=int, default=20)
    parser.add_argument("command", nargs="*", help="a prompt command such as: .find '{\"age\": 3}'")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lodestone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("WARN" if args.verbose else "ERROR")
    if not args.database:
        print("\n".join(discover(".", spark)) or "no databases here")
        return 0
    shell = Shell(Database(spark, args.database), args.page_size, args.sample)
    shell.current = args.collection
    if args.command:
        print(shell.run(" ".join(args.command)))
    while args.repl:
        try:
            line = input("> ")
        except EOFError:
            break
        if line.strip() in (".quit", ".exit"):
            break
        print(shell.run(line))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
