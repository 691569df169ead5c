"""Operations for large training-text pipelines.

Nothing outside this folder imports it, so the rest of the engine works without it.
"""
