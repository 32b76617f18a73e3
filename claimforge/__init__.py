"""A PySpark engine for evidence-grounded knowledge construction from anchored documents."""
