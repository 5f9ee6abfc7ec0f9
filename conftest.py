"""Puts the repository on the path of tests and of the workers they start."""

import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
