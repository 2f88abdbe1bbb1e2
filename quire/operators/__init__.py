"""Operators: grading, scoreboards, splits, tokens, language models, losses, needles,
quantisation, batch inference and distillation, each as DataFrame jobs."""
