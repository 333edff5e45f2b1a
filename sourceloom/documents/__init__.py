"""Prompt texts, the model provider boundary and generated documents."""

from sourceloom.documents.generate import DocResult, write_documents
from sourceloom.documents.prompts import PROMPTS, document_fingerprints, register_document
from sourceloom.documents.provider import Provider, available_providers, get_provider

__all__ = ["PROMPTS", "DocResult", "Provider", "available_providers", "document_fingerprints", "get_provider", "register_document", "write_documents"]
