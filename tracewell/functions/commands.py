"""Lexical command splitting (E19, E22, E24, P06), over distinct commands in Arrow batches.

Narrower than a shell grammar: quotes, separators, assignments, wrappers and redirections are seen; variables, braces and globs are not
resolved, so file counts from these parts alone are a floor.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARSER = 2
#: Programs that run the command after them; with the options that take a value (fixed values).
WRAPPERS = {"env": ("-u", "-C"), "nice": ("-n",), "timeout": ("-s", "-k"), "sudo": ("-u", "-g"), "nohup": (), "time": (), "command": (), "exec": (), "stdbuf": ("-o", "-e", "-i"), "xargs": ("-n", "-I", "-P", "-L")}
SEPARATORS = re.compile(r"&&|\|\||;;|[;&|\n()]")
READERS = ("cat", "head", "tail", "less", "more", "nl", "wc")
RUNNERS = {"pytest": "pytest", "vitest": "vitest", "jest": "jest"}
SCRIPT_RUNNERS = ("npm", "pnpm", "yarn", "bun")
#: A part of a command. stdout: a file takes its output; fed: its input is a heredoc or a here-string; expands: see Segment; script: see script_of().
PART = "seq int, program string, args string, files string, conditional int, stdout boolean, fed boolean, expands boolean, script string"
ASSIGNMENT = re.compile(r"^[A-Za-z_]\w*=")


#: By the quote that is open, what can be taken into a word at once: no character of it means anything else.
PLAIN = {"'": re.compile(r"[^']*"), '"': re.compile(r'[^"\\`$]*'), "": re.compile(r"[\w./:=,@%+-]*")}
#: In front of a word that is a redirection operator, so that a quoted > is told from one.
OPERATOR = "\0"
HEREDOC = re.compile(r"(?P<head><<-?\s*(['\"]?)(?P<end>\w+)\2[^\n]*)\n(?P<body>.*?)(?:^|(?<=\n))[\t ]*(?P=end)(?=\n|$)", re.S)
PRINTED = re.compile(r"\$\(date[^)]*\)")


#: Words of the shell's own that a command may stand after, that open what is no command, and that close a group (fixed values).
BEFORE, NO_COMMAND, CLOSING = ("if", "then", "elif", "else", "do", "while", "until", "!", "{"), ("for", "case", "select", "function"), ("done", "fi", "esac", "}")
#: What a script says when it writes or reads files.
SCRIPT_WRITES = re.compile(r"""\bopen\([^()]*,\s*(?:mode\s*=\s*)?['"][rbt]*[wax+]|\.write_(?:text|bytes)\(|\b(?:writeFile|appendFile)(?:Sync)?\(|createWriteStream\(|\bshutil\.(?:copy|move)\w*\(|\bos\.(?:replace|rename)\(""")
SCRIPT_READS = re.compile(r"""\bopen\(|\.read_(?:text|bytes)\(|\b(?:glob|listdir|walk|scandir|iterdir|stat|exists)\(""")
SCRIPT_OPTIONS = {"python": "-c", "node": "-e", "nodejs": "-e"}


class Segment(NamedTuple):
    words: list[str]
    conditional: bool  # it follows && or ||
    expands: bool  # a word holds what another command prints or returns, other than the time
    body: str | None  # of its heredoc


def substitution(command: str, at: int) -> int:
    """The end of the $( ) or the backticks that start at a place."""
    if command[at] == "`":
        return command.find("`", at + 1) + 1 or len(command)
    depth, i = 1, at + 2
    while i < len(command) and depth:
        depth += {"(": 1, ")": -1}.get(command[i], 0)
        i += 1
    return i


def segments(command: str) -> list[Segment] | None:
    """Simple commands, the bodies of heredocs apart; None if quotes do not balance."""
    bodies: list[str] = []

    def without_body(m: re.Match) -> str:
        bodies.append(m["body"])
        return m["head"]

    command = HEREDOC.sub(without_body, command)
    out, words, word, quote, conditional, expands, i = [], [], None, "", False, False, 0

    def body_of(words: list[str]) -> str | None:
        own = [bodies.pop(0) for w in words if w.startswith(OPERATOR) and "<<" in w and not w.endswith("<<<") and bodies]
        return own[-1] if own else None

    def end_of_word() -> None:
        nonlocal word
        if word is not None:
            words.append(word)
        word = None

    while i < len(command):
        c = command[i]
        if quote != "'" and (c == "`" or command.startswith("$(", i)):
            stop = substitution(command, i)
            word = (word or "") + command[i:stop]
            expands |= not PRINTED.fullmatch(command[i:stop])
            i = stop - 1
        elif quote:
            if c == quote:
                quote = ""
            elif c == "\\" and quote == '"' and i + 1 < len(command):
                i += 1
                word = (word or "") + command[i]
            else:
                expands |= quote == '"' and command.startswith(("$?", "${?"), i)
                run = PLAIN[quote].match(command, i + 1).end()
                word, i = (word or "") + command[i:run], run - 1
        elif c in "'\"":
            quote, word = c, word or ""
        elif c == "\\" and i + 1 < len(command):
            i += 1
            if command[i] != "\n":
                word = (word or "") + command[i]
        elif command.startswith("&>", i) or c in "<>":
            number = word if word and word.isdigit() else ""
            if not number:
                end_of_word()
            m = re.compile(r"&>>?|<<<|<<-?|<|>>|>\||>&[\d-]?|>").match(command, i)
            words.append(OPERATOR + number + m[0])
            word, i = None, m.end() - 1
        elif m := SEPARATORS.match(command, i):
            end_of_word()
            if words:
                out.append(Segment(words, conditional, expands, body_of(words)))
            conditional, words, expands = m[0] in ("&&", "||"), [], False
            i = m.end() - 1
        elif c.isspace():
            end_of_word()
        elif c == "#" and word is None:
            i = command.find("\n", i) - 1
            if i < -1:
                break
        else:
            expands |= command.startswith(("$?", "${?"), i)
            run = PLAIN[""].match(command, i + 1).end()
            word, i = (word or "") + command[i:run], run - 1
        i += 1
    if quote:
        return None
    end_of_word()
    if words:
        out.append(Segment(words, conditional, expands, body_of(words)))
    return out


def unwrapped(words: list[str]) -> list[str]:
    """Words without assignments and words of the shell's own in front, and without the wrappers that run them."""
    while words:
        if words[0] in NO_COMMAND:
            return []
        if words[0] in BEFORE or words[0] in CLOSING:
            words = words[1:]
            continue
        if ASSIGNMENT.match(words[0]):
            words = words[1:]
            continue
        name = words[0].rsplit("/", 1)[-1]
        if name not in WRAPPERS:
            return words
        rest = words[1:]
        while rest and (rest[0].startswith("-") or ASSIGNMENT.match(rest[0])):
            rest = rest[2:] if rest[0] in WRAPPERS[name] else rest[1:]
        if name == "timeout" and rest:
            rest = rest[1:]
        words = rest
    return words


class Redirected(NamedTuple):
    words: list[str]  # without redirections
    files: list[str]  # that it writes
    stdout: bool  # one of them takes its standard output
    fed: bool  # a heredoc or a here-string is its input


def redirected(words: list[str]) -> Redirected:
    kept, files, stdout, fed, i = [], [], False, False, 0
    while i < len(words):
        if not words[i].startswith(OPERATOR):
            kept.append(words[i])
        elif not re.search(r">&[\d-]$", words[i]):  # the word after it is its target
            i += 1
            if "<<" in words[i - 1]:
                fed = True
            elif ">" in words[i - 1] and i < len(words) and words[i] != "/dev/null":
                files.append(words[i])
                stdout |= not words[i - 1].startswith(f"{OPERATOR}2")
        i += 1
    return Redirected(kept, files, stdout, fed)


def test_runner(command: str) -> str | None:
    """The test runner of the first segment that is a test."""
    for segment in segments(command) or []:
        words = unwrapped(redirected(segment.words).words)
        if not words:
            continue
        name, rest = words[0].rsplit("/", 1)[-1], [w for w in words[1:] if not w.startswith("-")]
        if name in RUNNERS:
            return RUNNERS[name]
        if name in ("python", "python3") and words[1:3] == ["-m", "pytest"]:
            return "pytest"
        if name in ("go", "cargo") and rest[:1] == ["test"]:
            return name
        if name in SCRIPT_RUNNERS and (rest[:1] == ["test"] or rest[:2] == ["run", "test"]):
            return name
        if name in ("npx", "bunx") and rest[:1] and rest[0] in RUNNERS:
            return RUNNERS[rest[0]]
    return None


def cut_content(command: str) -> tuple[str | None, int, int]:
    """The command without what it writes, and the bytes cut: of heredoc bodies, and of operands (commit messages, echo and printf operands that go to a file,
    here-strings). A command whose quotes do not balance keeps its size only."""
    heredocs = operands = 0

    def heredoc(m: re.Match) -> str:
        nonlocal heredocs
        heredocs += len(m["body"].encode())
        return f"{m['head']}\n{m['end']}"

    text = HEREDOC.sub(heredoc, command)
    if segments(re.sub(r"<<-?\s*['\"]?\w+['\"]?", "", text)) is None:
        return None, 0, 0
    operand = r"(?:'[^']*'|\"(?:[^\"\\]|\\.)*\"|[^\s;&|<>]+)"

    def hide(m: re.Match) -> str:
        nonlocal operands
        if m["x"] == "'[cut]'":
            return m[0]
        operands += len(m["x"].encode())
        return m["a"] + "'[cut]'" + (m.groupdict().get("z") or "")

    text = re.sub(rf"(?P<a>\bcommit\b[^;&|\n]*?\s(?:-m|--message)[ =]?)(?P<x>{operand})", hide, text)
    text = re.sub(rf"(?P<a><<<\s*)(?P<x>{operand})", hide, text)
    text = re.sub(rf"(?P<a>\b(?:echo|printf)\s+(?:-\w+\s+)*)(?P<x>{operand}(?:\s+{operand})*)(?P<z>\s*(?:>|\|\s*tee\b))", hide, text)
    return text, heredocs, operands


def script_of(words: list[str], body: str | None) -> str | None:
    """Whether the script that an interpreter is given, by an option or as its input, `writes` or `reads` files; `runs` if neither."""
    name = words[0].rsplit("/", 1)[-1]
    option = SCRIPT_OPTIONS.get("python" if name.startswith("python") else name)
    if option is None:
        return None
    text = words[words.index(option) + 1] if option in words[1:-1] else body
    return None if text is None else "writes" if SCRIPT_WRITES.search(text) else "reads" if SCRIPT_READS.search(text) else "runs"


def parts_of(command: str) -> list[dict] | None:
    """The parts (PART) of a command; None if it does not split. What a group's output goes to is a matter of its first part that is no echo."""
    found, parts, groups = segments(command), [], []
    for seq, segment in enumerate(found or []):
        r = redirected(segment.words)
        words = unwrapped(r.words)
        groups += [len(parts)] * (r.words[:1] == ["{"])
        if r.words[:1] == ["}"] and groups:
            group = parts[groups.pop() :]
            part = next((p for p in group if p["program"] not in ("echo", "printf")), group[-1] if group else None)
            if part and r.files:
                part["files"] = json.dumps(json.loads(part["files"]) + [f"write\t\t?\t{w}" for w in r.files])
                part["stdout"] = part["stdout"] or r.stdout
            continue
        if not words and not r.files:
            continue
        name = words[0].rsplit("/", 1)[-1] if words else ""
        read = [w for w in words[1:] if not w.startswith("-")] if name in READERS else []
        files = [f"read-whole\t\t?\t{w}" for w in read] + [f"write\t\t?\t{w}" for w in r.files]
        parts.append({
            "seq": seq, "program": words[0] if words else "", "args": json.dumps(words[1:]), "files": json.dumps(files), "conditional": int(segment.conditional),
            "stdout": r.stdout, "fed": r.fed, "expands": segment.expands, "script": script_of(words, segment.body) if words else None,
        })
    return None if found is None else parts


def command_facts(commands: DataFrame) -> DataFrame:
    """(command, parts, test_runner, cut, cut_bytes, status) of the distinct commands of `commands` (command)."""
    schema = f"command string, parts array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>, test_runner string, cut string, cut_bytes int, status string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for command in f["command"]:
                parts = parts_of(command)
                cut, heredocs, operands = cut_content(command)
                size = len(command.encode()) if cut is None else heredocs + operands
                rows.append((command, parts or [], test_runner(command), cut, size, "error" if parts is None else "ok"))
            yield pd.DataFrame(rows, columns=["command", "parts", "test_runner", "cut", "cut_bytes", "status"])

    return commands.select("command").where("command is not null").distinct().mapInPandas(run, schema)


@F.pandas_udf(T.StringType())
def runner_of(commands: pd.Series) -> pd.Series:
    """E19 for a column: see test_runner(); nulls stay."""
    found = {c: None if c is None else test_runner(c) for c in commands.unique()}
    return pd.Series([found[c] for c in commands], dtype=object)


#: Of a part, what command_segments() gives besides its call and its seq.
PART_COLUMNS = ["program", "args", "files", "conditional", "stdout", "fed", "expands", "script", "parse_status", "parser"]


def with_parts(rows: DataFrame, *keys: str) -> DataFrame:
    """A row for each part of rows (keys, status, parts); one without a command that splits is a part of status `error`."""
    none = F.array(F.from_json(F.lit('{"seq": 0, "conditional": 0}'), PART))
    each = rows.select(*keys, F.col("status").alias("parse_status"), F.explode(F.when(F.col("status") == "ok", F.col("parts")).otherwise(none)).alias("p"))
    return each.select(*keys, "p.seq", *(f"p.{c}" for c in PART_COLUMNS[:-2]), "parse_status", F.lit(PARSER).alias("parser"))


def command_segments(calls: DataFrame) -> DataFrame:
    """command_parts of calls (tool_use_id, command), with stdout, fed and expands (see PART): each distinct command is split once."""
    parts = with_parts(calls.select("tool_use_id", "command").join(command_facts(calls), "command"), "tool_use_id")
    return parts.select("tool_use_id", "seq", F.lit("sh").alias("lang"), *PART_COLUMNS)


def split_commands(commands: DataFrame, key: str) -> DataFrame:
    """(key, seq, PART_COLUMNS): the parts of commands (key, command) that are distinct or few, split where they are."""
    schema = T.StructType([commands.schema[key], T.StructField("status", T.StringType()), T.StructField("parts", T.ArrayType(T.StructType.fromDDL(PART)))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [parts_of(c) for c in f["command"]]
            yield pd.DataFrame({key: f[key], "status": ["error" if x is None else "ok" for x in found], "parts": [x or [] for x in found]})

    return with_parts(commands.select(key, "command").mapInPandas(run, schema), key)


def parts_to_refresh(calls: DataFrame, parts: DataFrame, version: int = PARSER, retry: tuple[str, ...] = ("unparsed", "python-unavailable")) -> DataFrame:
    """Shell calls with an absolute cwd and a command that have no parts of this parser, or parts of a status to try again."""
    able = calls.where("tool = 'Bash' and cwd like '/%'").where(F.get_json_object("input", "$.command").isNotNull())
    done = parts.where(F.col("parser") == version).select("tool_use_id").distinct()
    again = parts.where(F.col("parse_status").isin(*retry)).select("tool_use_id").distinct()
    return able.join(done, "tool_use_id", "left_anti").unionByName(able.join(again, "tool_use_id", "left_semi")).dropDuplicates(["tool_use_id"])


def replace_parts(parts: DataFrame, new: DataFrame) -> DataFrame:
    """The parts of calls that were split again are replaced whole."""
    return parts.join(new.select("tool_use_id").distinct(), "tool_use_id", "left_anti").unionByName(new, allowMissingColumns=True)
