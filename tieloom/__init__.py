"""Ego-network analytics on large undirected, weighted co-occurrence networks.

Every operator is a plain function from DataFrames to a DataFrame. Graph patterns are
written as joins, so Catalyst plans them and Spark spreads them over the cluster.
"""
