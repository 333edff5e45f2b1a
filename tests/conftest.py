import subprocess
import sys
from pathlib import Path

import pytest
from support import HARBOUR, git

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sourceloom.documents.provider import Provider  # noqa: E402
from sourceloom.plans.analysis import Analysis  # noqa: E402
from sourceloom.session import local_session  # noqa: E402
from sourceloom.sources.parse import parse_files  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def parse(spark):
    """{path: source} -> parsed file rows."""

    def run(sources: dict):
        rows = [(p, s.encode() if isinstance(s, str) else s) for p, s in sources.items()]
        return parse_files(spark.createDataFrame(rows, "path string, content binary"))

    return run


@pytest.fixture(scope="session")
def analyse(parse):
    return lambda sources, **options: Analysis(parse(sources), **options)


@pytest.fixture(scope="session")
def harbour(analyse):
    return analyse(HARBOUR)


class EchoProvider(Provider):
    """Remembers prompts; answers with a fixed text."""

    def __init__(self, available=True, fail_on=None):
        self.prompts, self.available, self.fail_on = [], available, fail_on

    def is_available(self):
        return self.available

    def generate(self, prompt, system=None):
        if self.fail_on and self.fail_on in prompt:
            from sourceloom.documents.provider import ProviderError

            raise ProviderError("no answer")
        self.prompts.append(prompt)
        return f"text {len(self.prompts)}  "


@pytest.fixture
def echo():
    return EchoProvider


@pytest.fixture
def worktree(tmp_path):
    """The harbour sources in a Git repository with one commit."""
    root = tmp_path / "port"
    for path, source in HARBOUR.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(source)
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    git(root, "add", "-A")
    git(root, "commit", "-qm", "first")
    return root
