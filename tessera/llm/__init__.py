"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it; the queries built from it are in
:mod:`tessera.llm.queries`.
"""
