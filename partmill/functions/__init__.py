"""partmill.functions"""
