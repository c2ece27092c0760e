from landreach.plans.steps import main

main()
