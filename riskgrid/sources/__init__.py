"""Landing → bronze → silver/gold tables: explicit schemas, standardisers,
partitioned sinks and partition-pruned scans."""
