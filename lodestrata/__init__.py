"""Point-in-time record, code and text analytics on Spark.

Modules: ``functions`` (Column -> Column), ``sources`` (readers and writers), ``operators``
(DataFrame -> DataFrame), ``plans`` (queries over whole tables), ``streaming`` and the optional
subpackage ``llm``, which nothing else imports.
"""
