"""The dialect in front of Spark SQL, and plans in words and numbers."""
