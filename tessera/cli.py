"""A shell: statements end with a semicolon, commands begin with a dot. python -m tessera.cli [FOLDER]"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import NodeTable
from tessera.cypher.parser import RESERVED
from tessera.errors import GraphError
from tessera.session import GraphSession
from tessera.types import display

COMMANDS = {
    ".help": "this list",
    ".quit": "leave",
    ".exit": "leave",
    ".tables": "tables and their kinds",
    ".schema [TABLE]": "columns",
    ".database": "the open folder",
    ".open FOLDER": "open another folder",
    ".checkpoint": "drop files of old versions",
}
ROWS = 1000


def complete(text: str) -> list[str]:
    """Commands or keywords that begin with text."""
    if text.startswith("."):
        return sorted(c.split()[0] for c in COMMANDS if c.startswith(text))
    return sorted(w for w in RESERVED if text and w.startswith(text.upper()))


def hint(text: str) -> str:
    """What completes the last word of a line, if only one command or keyword can."""
    word = text.split()[-1] if text.split() and not text[-1].isspace() else ""
    found = complete(word) if word else []
    return found[0][len(word) :] if len(found) == 1 else ""


def table_text(df: DataFrame) -> str:
    """The first ROWS rows as a bordered table."""
    names = df.columns
    shown = df.toDF(*[f"c{k}" for k in range(len(names))])
    rows = shown.select(*[F.coalesce(display(F.col(f.name), f.dataType), F.lit("NULL")).alias(f.name) for f in shown.schema.fields]).limit(ROWS + 1).collect() if names else []
    body = [list(map(str, r)) for r in rows[:ROWS]]
    width = [max(map(len, col)) for col in zip(names, *body)]
    line = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    put = lambda cells: "|" + "|".join(f" {c:<{w}} " for c, w in zip(cells, width)) + "|"
    more = ["..."] if len(rows) > ROWS else []
    return "\n".join([line, put(names), line, *map(put, body), line, *more]) if names else "done"


class Shell:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root
        self.session = GraphSession(spark, root)
        self.held = ""

    def feed(self, line: str) -> str | None:
        """What to print after a line; None ends the shell."""
        if not self.held and line.strip().startswith("."):
            return self.command(line.strip())
        self.held += line + "\n"
        if not self.held.rstrip().endswith(";"):
            return ""
        text, self.held = self.held, ""
        began = time.time()
        try:
            out = self.session.execute_script(text)
            return f"{table_text(out)}\n({time.time() - began:.3f} s)" if out is not None else ""
        except (GraphError, OSError) as e:
            return f"error: {e}"

    def command(self, line: str) -> str | None:
        name, *args = line.split()
        if name in (".quit", ".exit"):
            return None
        if name == ".help":
            return "\n".join(f"{k:<18}{v}" for k, v in COMMANDS.items())
        if name == ".tables":
            return table_text(self.session.call("dbms.tables"))
        if name == ".schema":
            tables = [t for t in self.session.catalog.tables.values() if not args or t.name in args]
            return "\n".join(f"{t.name} ({', '.join(f'{c} {k.simpleString()}' for c, k in t.columns.items())})" + (f" key {t.key}" if isinstance(t, NodeTable) else f" {t.source} -> {t.target}") for t in tables)
        if name == ".database":
            return self.root or "in memory"
        if name == ".open" and args:
            self.root, self.session = args[0], GraphSession(self.spark, args[0])
            return f"opened {args[0]}"
        if name == ".checkpoint":
            self.session.checkpoint()
            return "done"
        return f"unknown command {name}; see .help"


def main() -> None:
    spark = SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    shell = Shell(spark, sys.argv[1] if len(sys.argv) > 1 else None)
    try:
        import readline

        readline.set_completer(lambda text, k: (complete(text) + [None])[k])
        readline.set_completion_display_matches_hook(lambda word, found, width: print("\n" + "  ".join(found) + f"\n> {readline.get_line_buffer()}", end="", flush=True))
        readline.parse_and_bind("tab: complete")
    except ImportError:
        pass
    while True:
        try:
            out = shell.feed(input("... " if shell.held else "> "))
        except EOFError:
            break
        if out is None:
            break
        if out:
            print(out)


if __name__ == "__main__":
    main()
