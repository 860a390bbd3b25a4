"""Evidence-backed decisions, document analytics and audits as Spark DataFrame pipelines."""
