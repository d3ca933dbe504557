"""Running programs row by row (U1, U2), off unless asked for.

Each program runs in a child process of its own with a time limit and a memory limit; it is no sandbox. Whoever turns it on answers for what the
programs may do.
"""

from __future__ import annotations

import json
import subprocess
import sys
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "key string, status string, passed array<boolean>, errors array<string>"
# The statuses of a run.
OK, TIMEOUT, BROKEN, FAILED_START = "ok", "timeout", "execution_error", "initialization_error"

#: The child reads a list of programs (the candidate, then its tests), runs them in one namespace, and reports each on a pipe of its own, a line
#: at once when it is done; so what programs print, and where they die, cannot be taken for a report.
_CHILD = """
import json, os, resource, sys
report, memory, programs = os.fdopen(int(sys.argv[1]), "w"), int(sys.argv[2]), json.load(sys.stdin)
resource.setrlimit(resource.RLIMIT_AS, (memory, memory))
names = {"__name__": "candidate"}
for place, program in enumerate(programs):
    error = ""
    try:
        exec(compile(program, "<test>" if place else "<candidate>", "exec"), names)
    except BaseException as found:
        error = (type(found).__name__ + ": " + str(found))[:300]
    report.write(json.dumps(error) + chr(10))
    report.flush()
    if error and not place:
        break
"""


def _reports(programs: list[str], timeout: float, memory: int) -> tuple[list[str], bool, str]:
    """The error ('' for none) of each program that came to an end, whether time ran out, and the end of what went wrong outside of them."""
    with tempfile.TemporaryFile("w+") as heard, tempfile.TemporaryFile("w+") as said:
        child = subprocess.Popen([sys.executable, "-I", "-c", _CHILD, str(heard.fileno()), str(memory)], stdin=subprocess.PIPE, stdout=subprocess.DEVNULL, stderr=said, text=True, pass_fds=[heard.fileno()])
        late = False
        try:
            child.communicate(json.dumps(programs), timeout=timeout)
        except subprocess.TimeoutExpired:
            child.kill()
            child.communicate()
            late = True
        heard.seek(0)
        said.seek(0)
        return [json.loads(line) for line in heard if line.endswith("\n")], late, said.read()[-1000:]


def run_program(code: str, tests: list[str], timeout: float = 15.0, memory: int = 4 << 30) -> tuple[str, list[bool], list[str]]:
    """(status, passed, errors): tests run in order in one namespace; a timeout, or a program that does not start, fails them all."""
    errors, late, outside = _reports([code, *tests], timeout, memory)
    if late:
        status, reason = TIMEOUT, "timeout"
    elif errors and errors[0]:
        status, reason = FAILED_START, errors[0]
    elif len(errors) <= len(tests):
        status, reason = BROKEN, outside
    else:
        return OK, [not e for e in errors[1:]], errors[1:]
    return status, [False] * len(tests), [reason] * len(tests)


def execute(df: DataFrame, key: str, code: str, tests: str, timeout: float = 15.0, memory: int = 4 << 30, allow: bool = False) -> DataFrame:
    """key, status, passed, errors of each row's program against its tests."""
    if not allow:
        raise PermissionError("programs run only with allow=True")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *run_program(c or "", list(t) if t is not None else [], timeout, memory)) for k, c, t in zip(batch["key"], batch["code"], batch["tests"])]
            yield pd.DataFrame(rows, columns=["key", "status", "passed", "errors"])

    return df.selectExpr(f"cast({key} as string) as key", f"{code} as code", f"{tests} as tests").mapInPandas(run, SCHEMA)


def all_passed(results: DataFrame) -> DataFrame:
    """Key, whether every test passed, and the first error."""
    return results.selectExpr("key", "status = 'ok' AND forall(passed, x -> x) AS passed", "get(filter(errors, x -> x <> ''), 0) AS error")
