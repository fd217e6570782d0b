"""Call classification (K01-K04): what calls did, by rules over the parts of their commands, as column expressions and joins."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.commands import PARSER, PART, PART_COLUMNS, parts_of, split_commands

#: Classes, the first that a call holds being its class (fixed order).
CLASSES = ("edit", "test", "git", "housekeeping", "search", "read", "capture", "wait", "spawn", "other")
#: Tools other than the shell (fixed values).
TOOLS = {
    "edit": ("Edit", "Write", "MultiEdit", "NotebookEdit", "apply_patch"), "read": ("Read", "NotebookRead", "LS"), "search": ("Grep", "Glob"), "spawn": ("Agent", "Task", "SendMessage"),
    "wait": ("TaskOutput", "BashOutput", "Monitor", "AgentOutputTool", "KillShell", "TaskStop", "ScheduleWakeup"),
}
#: Programs of one class (fixed values). Neutral ones print or set the shell's state and have none.
READ = (
    "cat head tail less more wc jq yq stat file tree diff cmp awk gawk cut sort uniq tr nl column xxd od hexdump strings shasum md5 md5sum sha1sum sha256sum pwd which whereis type command du df realpath basename "
    "dirname readlink date env printenv id whoami uname hostname ps lsof tac rev paste comm join fold base64 ls expr bc seq uptime nproc lscpu sw_vers"
).split()
SEARCH = "grep egrep fgrep rg ag ack find fd locate mdfind".split()
HOUSEKEEPING = "mkdir rmdir rm mv cp chmod chown chgrp ln touch install truncate mktemp unlink rsync tar unzip zip mkfifo".split()
WAIT = ("sleep", "wait")
#: Operands that a reader needs before it names a file; with fewer it filters its input (fixed values).
OPERANDS = {
    1: "cat head tail less more wc sort uniq cut column nl tac rev paste fold base64 xxd od hexdump strings".split(), 2: "jq yq awk gawk sed".split(), 99: ["tr"],
}
#: Git verbs: that read; that change state; that read when bare or asked to list (fixed values).
GIT_READ = (
    "log show diff status blame grep ls-files rev-parse cat-file rev-list merge-base describe ls-tree shortlog reflog for-each-ref name-rev check-ignore count-objects whatchanged diff-tree diff-index diff-files var "
    "version help archive ls-remote merge-tree show-ref cherry range-diff show-branch fsck verify-commit hash-object"
).split()
GIT_STATE = (
    "add commit checkout switch reset merge rebase cherry-pick revert restore clean mv rm fetch pull push init clone am bisect gc prune update-ref symbolic-ref filter-repo merge-file read-tree write-tree apply stash"
).split()
GIT_LISTING = "branch remote worktree config stash tag submodule notes".split()
GIT_LIST_WORDS = "list show get -l -a -v -vv -r --list --show-current --get --get-all --verbose --contains --merged --no-merged --points-at status".split()
GIT_TAG_STATE = "-a --annotate -s --sign -u --local-user -m --message -F --file -f --force -d --delete".split()
#: Names of scripts that test, words of SQL that write, and package scripts that build or test (fixed patterns).
TEST_SCRIPT = r"^(check|checks|test|tests|verify|gate|lint|typecheck|e2e|leak-check|run-tests?|ci|vet)([-_.].*)?\.(sh|py|mjs|js|ts|bash)$|[-_](check|test|tests|gate)\.(sh|py|mjs|bash)$"
SQL_WRITE = r"(?i)\b(insert|update|delete|create|drop|alter|replace|vacuum|attach)\b"
PACKAGE_TEST = r"test|build|lint|check|typecheck|verify|tsc|vet|e2e"
TEST_MODULES = "pytest unittest tox nox mypy ruff pyright doctest compileall".split()
TESTERS = (
    "pytest tsc vitest jest mypy shellcheck make gmake gradle gradlew mvn ctest tox nox pyright playwright bats hadolint actionlint yamllint markdownlint staticcheck govulncheck"
).split()
FORMATTERS = "gofmt goimports gofumpt shfmt autopep8 isort rustfmt".split()
SCRIPT_HOSTS = ("node", "nodejs", "tsx", "bash", "sh", "zsh")
#: Options whose next word is their value: of interpreters, and of git (fixed values).
HOST_VALUES, GIT_VALUES = ("-W", "-X", "-r", "--require", "--import"), ("-C", "-c", "--git-dir", "--work-tree", "--namespace")
CONTAINERS, SHELLS = ("docker", "podman"), ("bash", "sh", "zsh")
#: Rules of a project. kind tool: name is a tool, class its class. wrapper: name is a program that runs what stands after the words `args`. test: name is a program that tests if given one of the words `args`.
#: Programs whose words are what they print, read, search or move, so name no program.
ONLY_NAMES = {"echo", "printf", *SEARCH, *HOUSEKEEPING, *READ} - {"env", "command"}
RULES_DDL = "kind string, name string, args string, class string"
DEPTH = 3


def base() -> Column:
    return F.col("base")


def args_() -> Column:
    return F.col("a")


def none() -> Column:
    return F.array().cast("array<string>")


def base_name(program: str | Column = "program") -> Column:
    return F.element_at(F.split(program, "/"), -1)


def words_of(column: str = "args") -> Column:
    return F.coalesce(F.from_json(column, "array<string>"), none())


def operands(a: Column) -> Column:
    return F.filter(a, lambda x: (x != "") & ~x.startswith("-"))


def at(a: Column, i: int) -> Column:
    return F.coalesce(F.try_element_at(a, F.lit(i)), F.lit(""))


def listed(words: Sequence[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def among(x: Column, words: Sequence[str]) -> Column:
    return F.array_contains(listed(words), x)


def any_of(a: Column, words: Sequence[str]) -> Column:
    return F.arrays_overlap(a, listed(words))


def first_place(a: Column, fits: object) -> Column:
    """The first place of `a`, from 1, where fits(word, the word before or empty, place) holds; null if none."""
    places = F.sequence(F.lit(1), F.size(a))
    found = F.filter(places, lambda i: fits(F.element_at(a, i), F.when(i > 1, F.element_at(a, F.greatest(i - 1, F.lit(1)))).otherwise(""), i))
    return F.when(F.size(a) > 0, F.try_element_at(found, F.lit(1)))


def after(a: Column, place: Column) -> Column:
    return F.slice(a, place + 1, F.greatest(F.size(a) - place, F.lit(0)))


def one(name: str) -> Column:
    return F.array(F.lit(name))


def cases(*pairs: tuple[Column, Column], otherwise: Column) -> Column:
    head, *rest = pairs
    return reduce(lambda c, p: c.when(*p), rest, F.when(*head)).otherwise(otherwise)


def in_place(values: str) -> Column:
    """An in-place option: -i, also in a cluster of letters before one that starts a value, or --in-place."""
    return F.exists(args_(), lambda x: (x == "--in-place") | x.startswith("--in-place=") | x.rlike(f"^-(?!-)[^i{values}]*i"))


def has(*words: str) -> Column:
    return any_of(args_(), words)


def git_class() -> Column:
    """Of git with verb and tail."""
    verb, tail, first = F.col("verb_"), F.col("tail_"), at(F.col("tail_"), 1)
    reads = (F.size(operands(tail)) == 0) | among(first, GIT_LIST_WORDS) | any_of(tail, ("-l", "--list", "-a", "-v", "-vv", "--show-current"))
    name = cases(
        (verb == "stash", F.when(first.isin("list", "show"), "read").otherwise("git")), ((verb == "tag") & any_of(tail, GIT_TAG_STATE), F.lit("git")), ((verb == "hash-object") & any_of(tail, ["-w"]), F.lit("git")), (verb == "grep", F.lit("search")),
        (verb == "apply", F.when(any_of(tail, ("--check", "--stat", "--numstat", "--summary")), "read").otherwise("edit")), (among(verb, GIT_READ), F.lit("read")), (among(verb, GIT_LISTING) & reads, F.lit("read")), otherwise=F.lit("git"),
    )
    return F.when(F.col("place_").isNull(), none()).otherwise(F.array(name))


def toolchain() -> Column:
    """Build, test and format programs; null for other programs."""
    verb, second, script = F.col("first_"), F.col("second_"), F.col("script_")
    test, edit, read = one("test"), one("edit"), one("read")
    edit_or = lambda cond, other: F.when(cond, edit).otherwise(other)
    package = among(verb, ("test", "build", "lint", "typecheck")) | (among(verb, ("run", "run-script", "exec")) & second.rlike(PACKAGE_TEST))
    return cases(
        (base() == "go", cases((among(F.col("word_"), ("test", "build", "vet", "install")), test), (F.col("word_") == "fmt", edit), otherwise=none())),
        (among(base(), FORMATTERS), edit_or(has("-w", "-i", "--write", "--in-place") | ((base() == "rustfmt") & ~has("--check")) | ((base() == "isort") & ~has("--check", "--check-only", "-c", "--diff")), read)),
        (base() == "prettier", edit_or(has("--write", "-w"), test)),
        (base() == "black", edit_or(~has("--check", "--diff"), test)),
        (base() == "ruff", edit_or(((verb == "format") & ~has("--check", "--diff")) | ((verb == "check") & has("--fix", "--fix-only")), test)),
        (base() == "rumdl", edit_or((verb == "fmt") | has("--fix"), test)),
        (among(base(), ("eslint", "golangci-lint")), edit_or(has("--fix"), test)),
        (base() == "cargo", cases(((verb == "fmt") & has("--check"), test), (verb == "fmt", edit), (among(verb, ("test", "build", "check", "clippy", "bench")), test), otherwise=none())),
        (among(base(), ("terraform", "tofu")), edit_or((verb == "fmt") & ~has("-check"), none())),
        (among(base(), ("npm", "pnpm", "yarn", "bun")), cases((package, test), (base() == "bun", script), otherwise=none())),
        (base() == "deno", cases((among(verb, ("test", "check", "lint", "bench")), test), (verb == "fmt", edit_or(~has("--check"), test)), otherwise=script)),
        (among(base(), ("npx", "bunx", "pnpx")), cases((among(verb, ("tsc", "vitest", "jest", "playwright", "mypy")), test), (((verb == "prettier") & has("--write", "-w")) | ((verb == "eslint") & has("--fix")), edit), (verb == "eslint", test), otherwise=none())),
        (among(base(), TESTERS), test),
        (base() == "docker", F.when(among(verb, ("build", "buildx", "compose")), test).otherwise(none())),
        otherwise=F.lit(None).cast("array<string>"),
    )


def with_own(parts: DataFrame) -> DataFrame:
    """parts (base, a, ruled, script) with `own`: what a program does, apart from where its output goes. ruled: a rule says that it tests; script: what its script does, else empty.

    Columns are made step by step, as later ones use those before them more than once.
    """
    python = (base() == "python") | base().rlike("^python[23]")
    # the word that decides: a verb past options and their values, a script, or an option that names what is run
    run = F.array_position(args_(), "run").cast("int")
    p = parts.withColumns({"ops_": operands(args_())}).withColumns({"first_": at(F.col("ops_"), 1), "second_": at(F.col("ops_"), 2), "from_": F.when((base() == "deno") & (at(F.col("ops_"), 1) == "run"), after(args_(), run)).otherwise(args_())})
    valued = lambda before: cases((base() == "git", among(before, GIT_VALUES)), (base() == "go", before == "-C"), otherwise=among(before, HOST_VALUES))
    option = lambda w, i: cases((python, (w == "-m") & (i < F.size("from_"))), (among(base(), ("git", "go")), F.lit(False)), otherwise=w == "--test")
    p = p.withColumn("place_", first_place(F.col("from_"), lambda w, before, i: ~valued(before) & (~w.startswith("-") | option(w, i))))
    p = p.withColumns({"word_": F.coalesce(F.element_at("from_", F.col("place_")), F.lit("")), "next_": F.coalesce(F.try_element_at("from_", F.col("place_") + 1), F.lit(""))})
    tests = cases((python & (F.col("word_") == "-m"), among(F.col("next_"), TEST_MODULES)), (F.col("word_") == "--test", F.lit(True)), otherwise=base_name("word_").rlike(TEST_SCRIPT))
    # words before a known verb of git may be what a variable gave
    known = (*GIT_READ, *GIT_STATE, *GIT_LISTING)
    p = p.withColumns({"script_": F.when(tests, one("test")).otherwise(none()), "rest_": F.when(base() == "git", F.slice("from_", F.coalesce("place_", F.lit(1)), F.size("from_"))).otherwise(none())})
    p = p.withColumn("verb_at_", F.coalesce(first_place(F.col("rest_"), lambda w, before, i: among(w, known)), F.lit(1)))
    p = p.withColumns({"verb_": F.coalesce(F.try_element_at("rest_", F.col("verb_at_")), F.lit("")), "tail_": after(F.col("rest_"), F.col("verb_at_"))})

    filtering = reduce(lambda x, y: x | y, (among(base(), programs) & (F.size("ops_") < n) for n, programs in OPERANDS.items()))
    sql_reads = has("-readonly") | F.exists(args_(), lambda x: x.contains("mode=ro") | x.contains("immutable=1")) | ~F.array_join(args_(), " ").rlike(SQL_WRITE)
    edits = cases((base() == "sed", in_place("ef")), (base() == "perl", in_place("eEMmIxF0CdD")), (base() == "ruby", in_place("eErICxF0KTW")), (among(base(), ("awk", "gawk")), has("inplace")), (base() == "patch", ~has("--dry-run")), (base() == "apply_patch", F.lit(True)), (among(base(), ("yq", "jq")), has("-i", "--inplace")), otherwise=F.lit(False))
    own = cases(
        (base() == "", none()),
        (edits, one("edit")),
        (among(base(), ("perl", "ruby", "patch")), none()),
        (F.col("script") == "writes", one("edit")),
        (F.col("script") != "", F.when(python & (F.col("script") == "reads"), one("read")).otherwise(none())),
        (python | among(base(), SCRIPT_HOSTS), F.when(F.col("ruled"), one("test")).otherwise(F.col("script_"))),
        (base() == "git", git_class()),
        (base() == "sqlite3", F.when(sql_reads, one("read")).otherwise(none())),
        (base() == "find", F.when(has("-delete"), F.array(F.lit("search"), F.lit("housekeeping"))).otherwise(one("search"))),
        (F.col("ruled") & ~among(base(), ("sed", "awk", "gawk", "yq", "jq")), one("test")),
        otherwise=F.coalesce(
            toolchain(),
            cases((among(base(), WAIT), one("wait")), (among(base(), HOUSEKEEPING), one("housekeeping")), (among(base(), SEARCH), one("search")), (among(base(), ["sed", *READ]), F.when(filtering, none()).otherwise(one("read"))), (base().rlike(TEST_SCRIPT), one("test")), otherwise=none()),
        ),
    )
    return p.withColumn("own", own).select(*parts.columns, "own")


def find_commands(a: Column) -> Column:
    """The commands, as words, that a find runs by -exec, -execdir, -ok or -okdir."""
    starts = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: F.element_at(a, i).isin("-exec", "-execdir", "-ok", "-okdir"))
    upto = lambda i: F.coalesce(first_place(after(a, i), lambda w, before, k: w.isin(";", r"\;", "+")) - 1, F.size(a) - i)
    return F.when(F.size(a) > 0, F.filter(F.transform(starts, lambda i: F.slice(a, i + 1, upto(i))), lambda c: F.size(c) > 0)).otherwise(F.array().cast("array<array<string>>"))


def normal(path: Column) -> Column:
    """A path without single dots and doubled or final slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"(^|/)(\./)+", "$1"), r"/{2,}|(?<=.)/$", "")


def with_rules(parts: DataFrame, rules: DataFrame | None) -> DataFrame:
    """parts with wrappers and tests, the rules (name, words) of each kind: one row, which goes to all parts."""
    empty = F.array().cast("array<struct<name:string,words:array<string>>>")
    if rules is None:
        return parts.withColumns({"wrappers": empty, "tests": empty})
    one_rule = F.struct("name", F.split("args", " ").alias("words"))
    of = lambda kind: F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("args") != ""), one_rule)))
    return parts.crossJoin(F.broadcast(rules.agg(of("wrapper").alias("wrappers"), of("test").alias("tests"))))


def programs_in(a: Column) -> Column:
    """The programs that a part names: its own, and those among its words, unless it is one that only prints, reads, searches or moves what it is given."""
    only_names = among(base(), ["echo", "printf", *SEARCH, *HOUSEKEEPING]) | (among(base(), READ) & ~base().isin("env", "command"))
    return F.concat(F.array(base()), F.when(only_names, none()).otherwise(F.transform(a, base_name)))


def wrapper_span() -> Column:
    """(cut, start): where the words of a wrapper's rule start in a part, and where the command after them does; null if none of the wrappers stands in it."""
    places = F.when(F.size("a") > 0, F.sequence(F.lit(1), F.size("a"))).otherwise(F.array().cast("array<int>"))

    def span(rule: Column) -> Column:
        named = F.array_position("named", rule["name"])  # 1 is the part's own program
        cut = F.filter(places, lambda i: (named > 0) & (i >= named) & (F.slice("a", i, F.size(rule["words"])) == rule["words"]))
        return F.struct(F.try_element_at(cut, F.lit(1)).alias("cut"), (F.try_element_at(cut, F.lit(1)) + F.size(rule["words"])).alias("start"))

    return F.try_element_at(F.filter(F.transform("wrappers", span), lambda x: x["cut"].isNotNull()), F.lit(1))


def enriched(parts: DataFrame, rules: DataFrame | None) -> DataFrame:
    """Parts with path, stdout, fed, expands, base, a (words), writes (files that its output goes to), wrapped (see wrapper_span()) and tests."""
    for name, value in {"path": F.lit(""), "stdout": F.lit(True), "fed": F.lit(False), "expands": F.lit(False), "script": F.lit("")}.items():
        parts = parts.withColumn(name, F.coalesce(name, value) if name in parts.columns else value)
    files = F.coalesce(F.from_json("files", "array<string>"), none())
    writes = F.transform(F.filter(files, lambda f: f.startswith("write\t")), lambda f: F.element_at(F.split(f, "\t"), -1))
    p = with_rules(parts, rules).withColumns({"base": base_name(F.coalesce("program", F.lit(""))), "a": words_of(), "writes": writes})
    return p.withColumn("named", programs_in(args_())).withColumn("wrapped", wrapper_span())


def part_classes(parts: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """K02 (id, path, seq, classes) of parts (id, seq, program, args, files, and of command_segments() and expand_wrapped(): path, stdout, fed, expands).

    Classes come from the program, its arguments and the files that its output goes to. A tee writes what the part before it says, and a
    move over a file from what an earlier part made of that file is an edit; both are judged inside a command (id, path), in order of seq. A parse_status of the parts is kept.
    """
    kept = [c for c in ("parse_status",) if c in parts.columns]
    # each distinct part is looked at once
    what = F.struct(*(c for c in ("program", "args", "files", "stdout", "fed", "expands", "script") if c in parts.columns)).alias("what")
    path = F.coalesce("path", F.lit("")) if "path" in parts.columns else F.lit("")
    named = parts.select("id", path.alias("path"), "seq", *kept, what)
    p = enriched(named.select("what").distinct().select("what", "what.*"), rules).withColumn("a", F.when(F.col("wrapped").isNull(), args_()).otherwise(F.slice("a", 1, F.col("wrapped.cut") - 1)))
    p = p.withColumn("named", programs_in(args_()))
    ruled = F.exists("tests", lambda t: (F.array_position("named", t["name"]) > 0) & F.arrays_overlap(F.slice("a", F.greatest(F.array_position("named", t["name"]), F.lit(1)), F.size("a")), t["words"]))
    p = p.withColumn("ruled", ruled)
    # a part, then the commands that a find runs
    row = lambda main, program, a, ruled, script: F.struct(F.lit(main).alias("main"), program.alias("base"), a.alias("a"), ruled.alias("ruled"), script.alias("script"))
    run = F.transform(F.when(base() == "find", find_commands(args_())).otherwise(F.array().cast("array<array<string>>")), lambda c: row(False, base_name(c[0]), after(c, F.lit(1)), F.lit(False), F.lit("")))
    rows = p.select("what", "writes", "stdout", "fed", "expands", F.explode_outer(F.concat(F.array(row(True, base(), args_(), F.col("ruled"), F.col("script"))), run)).alias("r"))
    rows = with_own(rows.select("what", "writes", "stdout", "fed", "expands", "r.*")).withColumn("ops", operands(args_()))
    has_file = F.exists("ops", lambda x: x != "/dev/null")
    authors = (base().isin("echo", "printf") & ~F.col("expands")) | ((base() == "cat") & F.col("fed") & ~has_file)
    moves = base().isin("mv", "cp") & (F.size("ops") >= 2)
    facts = [
        F.col("main"), F.col("own"), F.col("fed"), F.col("stdout"), F.col("writes"), authors.alias("authors"), ((base() == "tee") & has_file).alias("tees"),
        F.when(moves, F.try_element_at("ops", F.lit(1))).alias("source"), F.when(moves, normal(F.try_element_at("ops", F.lit(-1)))).alias("target"), F.transform(args_(), normal).alias("of"),
    ]
    looked = named.join(rows.select("what", F.struct(*facts).alias("of")), "what")
    group = looked.select("id", "path", F.struct("seq", *kept, "of.*").alias("part")).groupBy("id", "path").agg(F.collect_list("part").alias("all"))
    group = group.withColumn("mains", F.array_sort(F.filter("all", lambda x: x["main"]), lambda x, y: x["seq"] - y["seq"]))

    def judged(x: Column, i: Column) -> Column:
        before = (i > 0) & F.element_at("mains", F.greatest(i, F.lit(1)))["authors"]
        made = F.exists("mains", lambda q: (q["seq"] < x["seq"]) & F.array_contains(q["writes"], x["source"]) & F.array_contains(q["of"], x["target"]))
        to_file = cases((F.size(x["writes"]) == 0, none()), (x["stdout"] & x["authors"], one("edit")), otherwise=one("capture"))
        tee = cases((~x["tees"], none()), (x["fed"] | before, one("edit")), otherwise=one("capture"))
        moved = F.when(x["source"].isNotNull() & made, one("edit")).otherwise(none())
        inner = F.flatten(F.transform(F.filter("all", lambda q: ~q["main"] & (q["seq"] == x["seq"])), lambda q: q["own"]))
        return F.struct(x["seq"].alias("seq"), *(x[c].alias(c) for c in kept), F.array_distinct(F.concat(x["own"], inner, tee, moved, to_file)).alias("classes"))

    return group.select("id", "path", F.explode_outer(F.transform("mains", judged)).alias("p")).select("id", "path", "p.*")


def wrapped_command(program: str, args: list[str], wrappers: list[tuple[str, list[str]]]) -> str:
    """The command that a part runs by a wrapper's rule, or by a shell's -c in a container; empty if there is none."""
    name = program.rsplit("/", 1)[-1]
    only_names = name in ONLY_NAMES
    named = [name] + ([] if only_names else [a.rsplit("/", 1)[-1] for a in args])
    for wrapper, words in wrappers:
        if wrapper in named:
            for i in range(max(0, named.index(wrapper)), len(args)):
                if args[i : i + len(words)] == words:
                    return " ".join(args[i + len(words) :])
    if name in CONTAINERS:
        return next((args[i + 2] for i in range(len(args) - 2) if args[i] in SHELLS and args[i + 1] == "-c"), "")
    return ""


def nested(program: str, args: list[str], wrappers: list[tuple[str, list[str]]], levels: int, path: str = "") -> Iterator[dict]:
    """The parts of the command that a part runs, each with those that it runs before the next; path is that of the part."""
    command = wrapped_command(program, args, wrappers) if levels else ""
    if not command:
        return
    parts = parts_of(command)
    for part in [NOT_SPLIT] if parts is None else parts:
        yield {**part, "path": path, "parse_status": "error" if parts is None else "ok"}
        if parts is not None:
            yield from nested(part["program"] or "", json.loads(part["args"] or "[]"), wrappers, levels - 1, f"{path}/{part['seq']}")


#: What stands for the parts of a command that does not split.
NOT_SPLIT = {**dict.fromkeys(("program", "args", "files", "stdout", "fed", "expands", "script")), "seq": 0, "conditional": 0}
NESTED = f"array<struct<{PART.replace(' ', ':').replace(',:', ',')},path:string,parse_status:string>>"


def expand_wrapped(parts: DataFrame, rules: DataFrame | None = None, levels: int = DEPTH) -> DataFrame:
    """The parts, with path (empty), and those of commands that they wrap: of a shell's -c in a container, or by a rule of kind `wrapper`.

    The path of such a part is that of the part that runs it and its seq. Wrapped commands may wrap again, `levels` deep. A part that runs a command gets all that is in it from one pass of a
    Python function, depth first; other parts are not sent there.
    """
    columns = [c for c in parts.columns if c != "path"]

    @F.pandas_udf(NESTED)
    def inside(program: pd.Series, args: pd.Series, wrappers: pd.Series) -> pd.Series:
        def of(p: str | None, a: str | None, w: list | None) -> list[dict]:
            return [] if a is None else list(nested(p or "", json.loads(a), [(x["name"], list(x["words"])) for x in w], levels))

        return pd.Series([of(*x) for x in zip(program, args, wrappers, strict=True)], dtype=object)

    own = with_rules(parts, rules).withColumns({"base": base_name(F.coalesce("program", F.lit(""))), "a": words_of()})
    runs = base().isin(*CONTAINERS) | F.exists("wrappers", lambda w: F.array_contains(programs_in(args_()), w["name"]))
    path = F.coalesce("path", F.lit("")) if "path" in parts.columns else F.lit("")
    sent = own.select(*columns, path.alias("path"), inside(F.col("program"), F.when(runs, F.to_json("a")), "wrappers").alias("_inner"))
    prefix = F.concat("path", F.lit("/"), F.col("seq").cast("string"))
    types = dict(parts.dtypes)
    given = {"id": F.col("id"), "lang": F.lit("sh"), "parser": F.lit(PARSER)}
    fields = {*(f.split()[0] for f in PART.split(", ")), "parse_status"}

    def row(x: Column) -> Column:
        value = lambda c: (x[c] if c in fields else given.get(c, F.lit(None))).cast(types[c]).alias(c)
        return F.struct(*(value(c) for c in columns), F.concat(prefix, x["path"]).alias("path"))

    each = F.concat(F.array(F.struct(*columns, "path")), F.transform(F.coalesce("_inner", F.array().cast(NESTED)), row))
    return sent.select(F.explode(each).alias("p")).select("p.*")


def parse_status(parts: DataFrame) -> DataFrame:
    """K04 (id, status): of each call, the first part's status that is not ok."""
    place = F.struct("path", "seq") if "path" in parts.columns else F.col("seq")
    return parts.groupBy("id").agg(F.coalesce(F.min_by("parse_status", F.when(F.col("parse_status") != "ok", place)), F.lit("ok")).alias("status"))


def classify(calls: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """K01 (id, class, classes, status) of calls (id, tool, command): a shell call holds the classes of its parts, another that of its tool; rules of kind `tool` come first."""
    spark = calls.sparkSession
    tools = spark.createDataFrame([(t, c) for c, names in TOOLS.items() for t in names], "tool string, by_tool string")
    if rules is not None:
        own = rules.where("kind = 'tool'").select(F.col("name").alias("tool"), F.col("class").alias("by_tool"))
        tools = own.unionByName(tools.join(own.select("tool"), "tool", "left_anti"))
    is_shell = F.col("tool").isin("Bash", "bash")
    shell = calls.where(is_shell & F.col("command").isNotNull())
    # each distinct command is judged once
    commands = shell.select("command").distinct().select(F.col("command").alias("id"), "command")
    parts = expand_wrapped(split_commands(commands, "id").select("id", "seq", F.lit("sh").alias("lang"), *PART_COLUMNS), rules)
    status = F.coalesce(F.min_by("parse_status", F.when(F.col("parse_status") != "ok", F.struct("path", "seq"))), F.lit("ok"))
    judged = part_classes(parts, rules).groupBy(F.col("id").alias("command")).agg(F.array_distinct(F.flatten(F.collect_list("classes"))).alias("of_parts"), status.alias("status"))
    rows = calls.select("id", "tool", F.when(is_shell, F.col("command")).alias("command")).join(tools, "tool", "left").join(judged, "command", "left")
    order = F.array(*map(F.lit, CLASSES))
    got = F.when(is_shell, F.coalesce("of_parts", none())).otherwise(F.array_compact(F.array("by_tool")))
    got = F.filter(order, lambda c: F.array_contains(got, c))
    got = F.when(F.size(got) == 0, one("other")).otherwise(got)
    return rows.select("id", got[0].alias("class"), got.alias("classes"), F.coalesce("status", F.lit("ok")).alias("status"))
