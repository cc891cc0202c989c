from docweave.functions import answers, text, vectors  # noqa: F401
