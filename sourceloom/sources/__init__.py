"""Where source text comes from, and how it becomes tables."""

from sourceloom.sources.parse import file_hash, parse_files
from sourceloom.sources.registry import get_language, register_language
from sourceloom.sources.state import State, StateStore
from sourceloom.sources.worktree import list_files, read_contents, read_folder

__all__ = ["State", "StateStore", "file_hash", "get_language", "list_files", "parse_files", "read_contents", "read_folder", "register_language"]
