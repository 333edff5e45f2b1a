"""Writing the documents whose fingerprint moved."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame

from sourceloom.documents import texts
from sourceloom.documents.prompts import PROMPTS
from sourceloom.documents.provider import Provider
from sourceloom.logs import get_logger
from sourceloom.plans.context import ProjectContext

log = get_logger("documents")


@dataclass
class DocResult:
    filename: str
    written: bool
    reason: str


def write_documents(ctx: ProjectContext, decisions: DataFrame, docs: list[str], provider: Provider, folder: str | Path) -> list[DocResult]:
    """Ask the provider for every document to be written.

    `decisions` has one row per known document; prompts are built only for
    documents that are wanted and due.
    """
    decided = {r["doc"]: r for r in decisions.collect()}
    results, folder = [], Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    for doc in (d for d in PROMPTS if d in docs):
        due = decided[doc]
        if due["write"]:
            prompt = PROMPTS[doc](ctx).first()["prompt"]
            log.info("%s: prompt of %d characters", doc, len(prompt))
            now = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M UTC")
            body = provider.generate(prompt, texts.SYSTEM).rstrip() + texts.FOOTER.format(timestamp=now)
            (folder / doc).write_text(body, encoding="utf-8")
        log.info("%s: %s", doc, due["reason"])
        results.append(DocResult(doc, due["write"], due["reason"]))
    return results
