import sys

from sourceloom.cli import run

sys.exit(run())
