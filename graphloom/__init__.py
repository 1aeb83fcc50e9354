"""graphloom: document retrieval, graph analytics and answer evaluation as Spark DataFrame operators."""
