"""Label review on Spark: records, word tables, rules, queues and evaluation."""
