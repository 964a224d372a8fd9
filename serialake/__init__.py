"""serialake: DataFrame operators for lakes of collected serial content.

Raw pages, ordered parts of a work, registries and job events come in as tables;
every operator is ``DataFrame -> DataFrame`` (or builds a ``Column``) and leaves the
physical strategy to Spark.
"""
