"""Shared fixtures live in tests/conftest.py; this makes its helper modules importable from here too."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
